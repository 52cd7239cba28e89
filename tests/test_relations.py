"""Joins beyond equality, bags, grouping sets and frames against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from weftline.operators import meeting
from weftline.plans.document import read_plan, validate
from weftline.queries import col, node, pick, run, step, tab


def met(left, right, operation, outputs, **options):
    return run(left, pick("m", *outputs), {"m": node(operation, tab("source"), tab("other"), **options)}, {"other": right})


def rows(df):
    return Counter(map(tuple, df.collect()))


def findings(operation, **options):
    plan = read_plan({"intermediate_steps": {"m": node(operation, tab("source"), tab("source"), **options)}, "output_mappings": {"x": node("COPY", step("m"), column="x")}})
    return validate(plan, ["x"])


# ---- intervals ---------------------------------------------------------------------

SPANS = "id long, key string, lo double, hi double, at long, bin string, ls int"


def spans(spark, r, n, longest):
    out = []
    for i in range(n):
        lo = r.choice([None, r.uniform(-50, 50), float(r.randint(-5, 5))]) if r.random() < 0.9 else r.uniform(-50, 50)
        length = r.choice([0.0, r.expovariate(1.0), r.uniform(0, longest), -1.0])
        out.append((i, r.choice(["a", "a", "b", None]), lo, None if lo is None else lo + length, 1, "x", 2))
    return out


@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_range_join_against_all_pairs(spark, closed, how):
    r = random.Random(hash((closed, how)) % 99)
    a, b = spans(spark, r, 60, 80), spans(spark, r, 50, 5)
    left, right = (spark.createDataFrame(x, SPANS).repartition(3) for x in (a, b))
    right = right.withColumnRenamed("id", "other_id")

    def hit(x, y):
        if None in (x[1], y[1], x[2], y[2]) or x[1] != y[1]:
            return False
        if closed == "left":
            return x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
        return x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]

    pairs = [(x[0], y[0]) for x in a for y in b if hit(x, y)]
    with_one = {x for x, _ in pairs}
    want = {"inner": pairs, "left": pairs + [(x[0], None) for x in a if x[0] not in with_one], "left_semi": [(x,) for x in with_one], "left_anti": [(x[0],) for x in a if x[0] not in with_one]}[how]
    options = dict(left_on="key", right_on="key", left_start="lo", left_end="hi", right_start="lo", right_end="hi", closed=closed, how=how)
    got = met(left, right, "RANGE_JOIN", ("id", "other_id") if how in ("inner", "left") else ("id",), **options)
    assert rows(got) == Counter(want)


def test_points_and_times(spark):
    t = datetime(2024, 1, 1)
    points = spark.createDataFrame([(i, t + timedelta(hours=i)) for i in range(48)], "id long, at timestamp_ntz")
    days = spark.createDataFrame([(1, t, t + timedelta(days=1)), (2, t + timedelta(days=1), t + timedelta(days=2)), (3, t, t + timedelta(days=900))], "day long, begins timestamp_ntz, ends timestamp_ntz")
    got = met(points, days, "RANGE_JOIN", ("id", "day"), left_start="at", right_start="begins", right_end="ends", closed="left")
    assert rows(got) == Counter([(i, 1 + i // 24) for i in range(48)] + [(i, 3) for i in range(48)])
    none = met(points.limit(0), days, "RANGE_JOIN", ("id", "day"), left_start="at", right_start="begins", right_end="ends")
    assert none.count() == 0
    both_empty = met(points.limit(0), days.limit(0), "RANGE_JOIN", ("id", "day"), left_start="at", right_start="begins", right_end="ends", how="left")
    assert both_empty.count() == 0


def test_infinite_intervals(spark):
    inf = float("inf")
    a = spark.createDataFrame([(1, -inf, inf), (2, 0.0, 1.0), (3, float("nan"), 1.0)], "id long, lo double, hi double")
    b = spark.createDataFrame([(1, 0.5), (2, 1e300), (3, -7.0)], "p long, at double")
    assert rows(met(a, b, "RANGE_JOIN", ("id", "p"), left_start="lo", left_end="hi", right_start="at")) == Counter([(1, 1), (1, 2), (1, 3), (2, 1)])


def test_hot_keys_are_dealt_to_a_grid(spark, monkeypatch):
    monkeypatch.setattr(meeting.spread, "__defaults__", (20,))
    a = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", float(i % 10)) for i in range(300)], "id long, key string, at double")
    b = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}", float(i % 10), i % 10 + 0.5) for i in range(120)], "j long, key string, lo double, hi double")
    x, y, keys = meeting.spread(a, b, ["key"])
    assert keys == ["key", "g_row", "g_col"]
    assert max(r["count"] for r in x.groupBy(*keys).count().collect()) < 40
    got = met(a, b, "RANGE_JOIN", ("id", "j"), on="key", left_start="at", right_start="lo", right_end="hi")
    want = Counter((i, j) for i in range(300) for j in range(120) if ("hot" if i % 3 else f"k{i}") == ("hot" if j % 2 else f"k{j}") and j % 10 <= i % 10 <= j % 10 + 0.5)
    assert rows(got) == want


def test_range_join_has_no_cartesian_product(spark):
    a = spark.range(100).selectExpr("id", "id * 1.0D AS at")
    b = spark.range(50).selectExpr("id AS j", "id * 2.0D AS lo", "id * 2.0D + 1 AS hi")
    df = met(a, b, "RANGE_JOIN", ("id", "j"), left_start="at", right_start="lo", right_end="hi")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.count() == 100


# ---- nearest in time ---------------------------------------------------------------

EVENTS = "id long, key string, t double, left string, part int, found long, mine int, k_0 int"


def moments(r, n):
    return [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, float(r.randint(0, 30)), r.uniform(0, 30), float("inf")]) if r.random() < 0.8 else 7.0, "x", 1, 2, 3, 4) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_against_all_pairs(spark, direction, exact):
    r = random.Random(4)
    a, b = moments(r, 80), moments(r, 60)
    left, right = (spark.createDataFrame(x, EVENTS).repartition(5) for x in (a, b))
    right = right.withColumnRenamed("id", "j")
    want = []
    for x in a:
        best = None
        for y in b:
            if None in (x[1], x[2], y[1], y[2]) or x[1] != y[1] or not exact and x[2] == y[2]:
                continue
            before = y[2] <= x[2]
            gone = 0.0 if y[2] == x[2] else abs(x[2] - y[2])
            if direction == "backward" and not before or direction == "forward" and y[2] < x[2] or gone > 4:
                continue
            rank = (gone, not before, -y[0])
            if best is None or rank < best[0]:
                best = (rank, y[0])
        want.append((x[0], best and best[1]))
    options = dict(left_on="key", right_on="key", left_at="t", right_at="t", direction=direction, exact=exact, tolerance=4)
    assert rows(met(left, right, "ASOF_JOIN", ("id", "j"), **options)) == Counter(want)
    assert rows(met(left, right, "ASOF_JOIN", ("id", "j"), how="inner", **options)) == Counter(w for w in want if w[1] is not None)


def test_one_key_and_one_time_fill_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = spark.range(4000).selectExpr("id", "'hot' AS key", "CASE WHEN id % 2 = 0 THEN 5.0D ELSE id * 1.0D END AS t").repartition(4)
        b = spark.range(400).selectExpr("id AS j", "'hot' AS key", "id * 10.0D AS t")
        out = met(a, b, "ASOF_JOIN", ("id", "j"), left_on="key", right_on="key", left_at="t", right_at="t")
        got = {r.id: r.j for r in out.collect()}
        assert got == {i: 0 if i % 2 == 0 else i // 10 for i in range(4000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_of_times_without_keys(spark):
    t = datetime(2024, 3, 10)
    a = spark.createDataFrame([(1, t), (2, t + timedelta(seconds=5)), (3, None)], "id long, at timestamp_ntz")
    b = spark.createDataFrame([(1, t + timedelta(seconds=3), "p"), (2, t + timedelta(seconds=3), "q"), (3, t + timedelta(days=1), "r")], "j long, at timestamp_ntz, rank string")
    assert rows(met(a, b, "ASOF_JOIN", ("id", "j"), left_at="at", right_at="at", tolerance=2)) == Counter([(1, None), (2, 2), (3, None)])
    assert rows(met(a, b, "ASOF_JOIN", ("id", "j"), left_at="at", right_at="at", tolerance=1)) == Counter([(1, None), (2, None), (3, None)])
    assert rows(met(a, b.limit(0), "ASOF_JOIN", ("id", "j"), left_at="at", right_at="at")) == Counter([(1, None), (2, None), (3, None)])
    assert met(a.limit(0), b, "ASOF_JOIN", ("id", "j"), left_at="at", right_at="at").count() == 0
    lowest = met(a, b.selectExpr("j", "at", "rank", "-j AS worth"), "ASOF_JOIN", ("id", "j"), left_at="at", right_at="at", tie_by="worth")
    assert rows(lowest)[(2, 1)] == 1


# ---- any condition -----------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_theta_against_all_pairs(spark, how, broadcast):
    r = random.Random(2)
    a = [(i, r.choice([None, r.randint(0, 40)])) for i in range(50)] + [(7, 3)] * 40
    b = [(i, r.choice([None, r.randint(0, 40)])) for i in range(30)]
    pairs = [(x[0], y[0]) for x in a for y in b if None not in (x[1], y[1]) and x[1] > y[1] + 20]
    alone = [x for x in a if x[1] is None or not any(y[1] is not None and x[1] > y[1] + 20 for y in b)]
    want = {"inner": pairs, "left": pairs + [(x[0], None) for x in alone], "left_anti": [(x[0],) for x in alone], "left_semi": [(x[0],) for x in a if x not in alone]}[how]
    left, right = spark.createDataFrame(a, "id long, v long").repartition(3), spark.createDataFrame(b, "j long, v long").repartition(2)
    got = met(left, right, "THETA_JOIN", ("id", "j") if how in ("inner", "left") else ("id",), condition="v_x > v_y + 20", how=how, broadcast_rows=broadcast)
    assert rows(got) == Counter(want)


def test_the_grid_follows_the_counts(spark):
    assert meeting.grid(100, 100, 16) == (4, 4) and meeting.grid(10_000, 100, 16) == (16, 1) and meeting.grid(1, 10_000, 16)[0] == 1
    a = spark.range(400).selectExpr("1 AS same")
    b = spark.range(300).selectExpr("2 AS other")
    df = met(a, b, "THETA_JOIN", ("same", "other"), condition="same < other", broadcast_rows=0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.count() == 120_000
    assert met(a.limit(0), b, "THETA_JOIN", ("same", "other"), condition="same < other", broadcast_rows=-1).count() == 0


# ---- bags --------------------------------------------------------------------------


def bags(spark):
    a = [(1, "x", None)] * 3 + [(None, None, None)] * 2 + [(2, "y", 1.5)] * 2500 + [(3, "z", 0.0)]
    b = [("x", 1)] * 2 + [(None, None)] * 5 + [("q", 9)]
    c = [(1, "x", None), (2, "y", 1.5)]
    return [spark.createDataFrame(a, "i long, s string, d double").repartition(3), spark.createDataFrame(b, "s string, i int"), spark.createDataFrame(c, "i long, s string, d double")]


@pytest.mark.parametrize("every", [False, True])
def test_bags(spark, every):
    a, b, c = bags(spark)
    out = {}
    for op in ("INTERSECT", "EXCEPT"):
        two = run(a, pick("m", "i", "s", "d"), {"m": node(op, tab("source"), tab("b"), all=every)}, {"b": b, "c": c})
        three = run(a, pick("m", "i", "s", "d"), {"m": node(op, tab("source"), tab("b"), tab("c"), all=every)}, {"b": b, "c": c})
        out[op] = rows(two), rows(three)
    counts = [Counter({(1, "x", None): 3, (None, None, None): 2, (2, "y", 1.5): 2500, (3, "z", 0.0): 1}), Counter({(1, "x", None): 2, (None, None, None): 5, (9, "q", None): 1}), Counter({(1, "x", None): 1, (2, "y", 1.5): 1})]
    once = lambda x: Counter(dict.fromkeys(x, 1))
    if every:
        assert out["INTERSECT"] == (counts[0] & counts[1], counts[0] & counts[1] & counts[2])
        assert out["EXCEPT"] == (counts[0] - counts[1], counts[0] - counts[1] - counts[2])
    else:
        assert out["INTERSECT"] == (once(counts[0] & counts[1]), once(counts[0] & counts[1] & counts[2]))
        assert out["EXCEPT"] == (once(set(counts[0]) - set(counts[1])), once(set(counts[0]) - set(counts[1]) - set(counts[2])))


def test_bags_take_one_shuffle_and_empty_tables(spark):
    a, b, _ = bags(spark)
    df = run(a, pick("m", "i"), {"m": node("EXCEPT", tab("source"), tab("b"), all=True)}, {"b": b})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    for op, n in (("EXCEPT", 4), ("INTERSECT", 0)):
        assert run(a, pick("m", "i"), {"m": node(op, tab("source"), tab("b"))}, {"b": b.limit(0)}).count() == n


# ---- grouping sets -----------------------------------------------------------------


def test_real_nulls_are_kept_apart_from_subtotals(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", None, 5.0), (None, 1, 2.0), (None, None, None)], "k string, j int, v double")
    options = dict(by=["k", "j"], agg={"v": ["sum", "size"]}, sets="cube", null_keys=True, grouping_id="g")
    got = rows(run(df, pick("s", "k", "j", "g", "v_sum", "v_size"), {"s": node("GROUP_BY", tab("source"), **options)}))
    want = [("a", 1, 0, 10.0, 1), ("a", None, 0, 5.0, 1), (None, 1, 0, 2.0, 1), (None, None, 0, 0.0, 1), ("a", None, 1, 15.0, 2), (None, None, 1, 2.0, 2), (None, 1, 2, 12.0, 2), (None, None, 2, 5.0, 2), (None, None, 3, 17.0, 4)]
    assert got == Counter(want)
    dropped = run(df, pick("s", "k", "j", "v"), {"s": node("GROUP_BY", tab("source"), by=["k", "j"], agg={"v": "sum"}, sets=[["k"], []])})
    plan = dropped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("hashpartitioning") == 1
    assert rows(dropped) == Counter([("a", None, 10.0), (None, None, 10.0)])
    empty = run(df.limit(0), pick("s", "k", "v"), {"s": node("GROUP_BY", tab("source"), by=["k"], agg={"v": "sum"}, sets="rollup")})
    assert empty.count() == 0


# ---- frames ------------------------------------------------------------------------


def framed(df, **options):
    out = run(df, {"id": node("COPY", col("id")), "w": node("COPY", step("w"))}, {"w": node("WINDOW_APPLY", tab("source"), **options)}, row_id="id")
    return {r.id: r.w for r in out.collect()}


def test_frames_over_whole_tables(spark):
    r = random.Random(6)
    data = [(i, r.choice([None, r.randint(0, 9), 5]), r.choice([None, 1.0, 2.5]), 0, 1) for i in range(200)]
    df = spark.createDataFrame(data, "id long, o int, v double, part int, pos int").repartition(6)
    order = sorted(data, key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    at = {x[0]: k for k, x in enumerate(order)}
    value = lambda k: order[k][2] if 0 <= k < len(order) else None
    for k in (1, 3, 150, 500):
        assert framed(df, function="lag", target_column="v", order_by="o", offset=k) == {i: value(p - k) for i, p in at.items()}
    assert framed(df, function="lead", target_column="v", order_by="o", offset=2, default=-9.0) == {i: value(p + 2) if p + 2 < 200 else -9.0 for i, p in at.items()}
    tiles = framed(df, function="ntile", target_column="v", order_by="o", buckets=7)
    assert sorted(Counter(tiles.values()).values(), reverse=True) == [29, 29, 29, 29, 28, 28, 28] and all(tiles[a[0]] <= tiles[b[0]] for a, b in zip(order, order[1:], strict=False))
    assert set(framed(df.limit(3), function="ntile", target_column="v", order_by="o", buckets=7).values()) == {1, 2, 3}
    sums = framed(df, function="count", target_column="v", order_by="o", frame={"kind": "rows", "start": -40, "end": 3})
    assert sums == {i: sum(value(k) is not None for k in range(max(p - 40, 0), min(p + 3, 199) + 1)) for i, p in at.items()}
    near = framed(df, function="mean", target_column="v", order_by="o", frame={"kind": "range", "start": -1.5, "end": 0.5})
    for i, o, *_ in data:
        vs = [x[2] for x in data if x[2] is not None and (x[1] is None if o is None else x[1] is not None and o - 1.5 <= x[1] <= o + 0.5)]
        assert near[i] == pytest.approx(sum(vs) / len(vs))
    assert framed(df.limit(0), function="lag", target_column="v", order_by="o") == {}


def test_users_columns_survive_whatever_their_names(spark):
    from weftline.chaos import scenarios

    df = spark.createDataFrame([(i, i, i) for i in range(10)], "k long, __n long, __t long")
    assert scenarios.run_scenario("month_end_truncation", df, "k").columns == ["k", "__n", "__t"]
    odd = spark.createDataFrame([(i, i % 3, 1, 2) for i in range(9)], "__rid long, __v long, __p int, __q int")
    out = run(odd, {n: node("COPY", col(n)) for n in odd.columns} | {"r": node("COPY", step("r"))}, {"r": node("WINDOW_APPLY", tab("source"), function="rank", target_column="__v")})
    assert out.columns == ["__rid", "__v", "__p", "__q", "r"] and out.count() == 9


# ---- validation --------------------------------------------------------------------


def test_bad_options_are_found():
    assert findings("RANGE_JOIN", left_start="x") and findings("RANGE_JOIN", left_start="x", right_start="x", closed="up")
    assert findings("ASOF_JOIN", left_at="x") and findings("ASOF_JOIN", left_at="x", right_at="x", tolerance=-1) and findings("ASOF_JOIN", left_at="x", right_at="x", direction="up")
    assert findings("THETA_JOIN") and findings("THETA_JOIN", condition="x <") and findings("RANGE_JOIN", left_start="x", right_start="x", left_on=["x"])
    assert findings("GROUP_BY", by=["x"], agg={"x": "sum"}, sets="square") and findings("GROUP_BY", by=["x"], agg={"x": "sum"}, sets=[["y"]])
    assert findings("WINDOW_APPLY", function="lag", target_column="x") and findings("WINDOW_APPLY", function="ntile", target_column="x", order_by="x")
    assert findings("WINDOW_APPLY", function="sum", target_column="x", order_by="x", frame={"kind": "rows", "start": 2, "end": 1})
    assert findings("WINDOW_APPLY", function="sum", target_column="x", order_by="x", frame={"kind": "rows", "end": 1})
    assert not findings("RANGE_JOIN", left_start="x", right_start="x") and not findings("ASOF_JOIN", left_at="x", right_at="x", tolerance=1.5)


# ---- functions of the user's own ---------------------------------------------------


def test_user_functions(spark, monkeypatch):
    from weftline.operators import user

    monkeypatch.setattr(user, "AGGREGATES", {})
    monkeypatch.setattr(user, "TABLES", {})
    monkeypatch.setattr(user, "HELD_KEYS", 3)
    user.register_aggregate("mean_of", lambda v: {"n": int(v.notna().sum()), "s": float(v.sum())}, lambda xs: {"n": sum(x["n"] for x in xs), "s": sum(x["s"] for x in xs)}, lambda x: x["s"] / x["n"] if x["n"] else None, "struct<n:bigint,s:double>", "double")
    user.register_table_function("doubled", lambda it: (p.assign(w=p["v"] * 2)[["id", "w"]] for p in it), "id long, w double")
    with pytest.raises(ValueError):
        user.register_aggregate("mean_of", None, None, None, "double", "double")
    data = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 4 == 0 else float(i)) for i in range(200)] + [(900, None, 1.0), (901, "none", None)]
    df = spark.createDataFrame(data, "id long, k string, v double").repartition(6)
    got = rows(run(df, pick("a", "k", "m"), {"a": node("AGGREGATE_BY", tab("source"), by="k", column="v", function="mean_of", output="m")}))
    groups: dict = {}
    for _, k, v in data:
        if k is not None:
            groups.setdefault(k, []).append(v)
    assert {k: m for k, m in got} == {k: pytest.approx(sum(v for v in vs if v is not None) / len([v for v in vs if v is not None])) if any(v is not None for v in vs) else None for k, vs in groups.items()}
    assert run(df.limit(0), pick("a", "k"), {"a": node("AGGREGATE_BY", tab("source"), by="k", column="v", function="mean_of")}).count() == 0
    table = run(df, pick("t", "id", "w"), {"t": node("APPLY_TABLE", tab("source"), columns=["id", "v"], function="doubled")})
    assert table.where("id = 199").first().w == 398.0 and table.count() == 202
    assert findings("AGGREGATE_BY", by="x", column="x", function="absent") and findings("APPLY_TABLE", function="absent")


# ---- work by pairs -----------------------------------------------------------------


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_having_an_interval_makes_no_pairs(spark, how, monkeypatch):
    """Neither side is cut into bins: what reaches furthest is carried along."""
    monkeypatch.setattr(meeting, "in_bins", None)
    a = spark.range(3000).selectExpr("id", "id * 1.0D AS lo", "id + 0.5D AS hi")
    b = spark.range(300).selectExpr("id AS j", "id * 10.0D AS lo", "CASE WHEN id = 100 THEN 1500.0D ELSE id * 10.0D + 2 END AS hi")
    got = met(a, b, "RANGE_JOIN", ("id",), left_start="lo", left_end="hi", right_start="lo", right_end="hi", how=how)
    inside = {i for i in range(3000) if i % 10 <= 2 or 1000 <= i <= 1500}
    assert {r.id for r in got.collect()} == (inside if how == "left_semi" else set(range(3000)) - inside)


def partitions(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_few_bytes_of_many_pairs_fill_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(meeting, "TASK_PAIRS", 10_000)
    a, b = spark.range(2000).selectExpr("id", "id % 7 AS v", "id * 0.001D AS at").coalesce(1), spark.range(300).selectExpr("id AS j", "id % 5 AS w", "0.0D AS lo", "1.0D + id * 0.01D AS hi").coalesce(1)
    for broadcast in (0, 10_000):
        found = partitions(met(a, b, "THETA_JOIN", ("id", "j"), condition="v > w", broadcast_rows=broadcast))
        assert sum(found) == sum(1 for i in range(2000) for j in range(300) if i % 7 > j % 5) and sum(x > 0 for x in found) > 20
    found = partitions(met(a, b, "RANGE_JOIN", ("id", "j"), left_start="at", right_start="lo", right_end="hi"))
    assert sum(found) > 100_000 and len(found) > 10
