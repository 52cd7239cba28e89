"""Subqueries, sub-plans, samples, sketches, JSON and loops of the expression language."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions.expressions import ExpressionError, identifiers, parse
from weftline.operators.nested import inferred
from weftline.plans.compiler import compile_plan
from weftline.plans.document import PlanError, read_plan, validate
from weftline.queries import col, node, pick, run, step, tab


def rows(df):
    return Counter(map(tuple, df.collect()))


# ---- subqueries --------------------------------------------------------------------


def tables(spark, seed=1, empty=False):
    r = random.Random(seed)
    a = [(i, r.choice([None, 1, 2, 3]), r.choice([None, 1, 2, 3, 4])) for i in range(60)]
    b = [] if empty else [(r.choice([None, 1, 2]), r.choice([None, 1, 2, 3] if seed % 2 else [1, 2, 3])) for _ in range(25)]
    return a, b, spark.createDataFrame(a, "id long, g int, v int").repartition(3), spark.createDataFrame(b, "g int, w int")


def kept(a, b, operation, **options):
    return {r.id for r in run(a, pick("k", "id"), {"k": node(operation, tab("source"), tab("b"), **options)}, {"b": b}).collect()}


def sql_in(v, values):
    if not values:
        return False
    if v is None:
        return None
    return True if v in values else None if None in values else False


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("empty", [False, True])
def test_in_and_exists_have_sqls_nulls(spark, seed, empty):
    a, b, left, right = tables(spark, seed, empty)
    group = lambda g: [w for h, w in b if g is not None and h == g]
    for negate, want in ((False, True), (True, False)):
        assert kept(left, right, "WHERE_IN", column="v", sub_column="w", negate=negate) == {i for i, _, v in a if sql_in(v, [w for _, w in b]) is want}
        assert kept(left, right, "WHERE_IN", column="v", sub_column="w", on="g", negate=negate) == {i for i, g, v in a if sql_in(v, group(g)) is want}
        assert kept(left, right, "WHERE_EXISTS", on="g", negate=negate) == {i for i, g, _ in a if bool(group(g)) is want}
        assert kept(left, right, "WHERE_EXISTS", condition="v > w", negate=negate) == {i for i, _, v in a if any(v is not None and w is not None and v > w for _, w in b) is want}
        assert kept(left, right, "WHERE_EXISTS", negate=negate) == {i for i, _, _ in a if bool(b) is want}


def test_scalar_subqueries(spark):
    a, b, left, right = tables(spark)
    steps = {n: node("SCALAR_SUBQUERY", tab("source"), tab("b"), column="w", agg=how, **on) for n, how, on in (("n", "count", {"on": "g"}), ("s", "sum", {"on": "g"}), ("m", "max", {}))}
    out = run(left, {"id": node("COPY", col("id")), **{n: node("COPY", step(n)) for n in steps}}, steps, {"b": right})
    known = lambda g: [w for h, w in b if g is not None and h == g and w is not None]
    assert rows(out) == Counter((i, len(known(g)), sum(known(g)) if known(g) else None, 3) for i, g, _ in a)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


# ---- sub-plans ---------------------------------------------------------------------


def test_sub_plans_are_lowered_in_order(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, None)], "id long, v int")
    plan = read_plan({
        "sub_plans": {"second": {"source": "first", "output_mappings": {"w": node("COMPUTE_EXPR", formula="u * 2")}}, "first": {"output_mappings": {"id": node("COPY", col("id")), "u": node("COMPUTE_EXPR", formula="v + 1")}, "materialise": True}},
        "intermediate_steps": {"both": node("JOIN", tab("first"), tab("second"), how="cross")},
        "output_mappings": pick("both", "id", "w"),
    })
    assert len(compile_plan(plan, df).collect()) == 9
    assert not validate(plan, df.columns)


def test_bad_sub_plans_are_found():
    def findings(subs, outputs=None):
        return validate(read_plan({"sub_plans": subs, "output_mappings": outputs or {"x": node("COPY", col("x"))}}), ["x"], None, ["other"])

    copy = {"output_mappings": {"y": node("COPY", col("x"))}}
    assert not findings({"a": copy})
    assert findings({"a": {**copy, "source": "nobody"}}) and findings({"other": copy})
    assert findings({"a": {"output_mappings": {"y": node("COPY", col("absent"))}}})
    assert findings({"a": copy, "b": {"source": "a", "output_mappings": {"z": node("COPY", col("x"))}}})
    assert not findings({"a": copy, "b": {"source": "a", "output_mappings": {"z": node("COPY", col("y"))}}})
    assert any("cycle" in e for e in findings({"a": {**copy, "source": "b"}, "b": {**copy, "source": "a"}}))
    with pytest.raises(PlanError):
        read_plan({"sub_plans": {"a": {"sub_plans": {"b": copy}, "output_mappings": {}}}, "output_mappings": {}})
    with pytest.raises(PlanError):
        read_plan({"sub_plans": {"a": {"unknown": 1}}, "output_mappings": {}})


# ---- samples -----------------------------------------------------------------------


def test_samples_are_exact_and_repeat(spark):
    data = [(i, r, "x") for i, r in ((i, None if i % 7 == 0 else f"s{i % 3}") for i in range(900))] + [(1000, "few", "x")] * 3
    df = spark.createDataFrame(data, "id long, s string, __bin string").repartition(5)
    for n in (0, 1, 37, 5000):
        got = run(df, pick("a", "id", "s"), {"a": node("SAMPLE", tab("source"), n=n)})
        assert got.count() == min(n, len(data))
    strata = run(df, pick("a", "id", "s"), {"a": node("SAMPLE", tab("source"), n=20, by="s")})
    assert rows(strata.groupBy("s").count()) == Counter([(None, 20), ("s0", 20), ("s1", 20), ("s2", 20), ("few", 3)])
    again = run(df.repartition(2), pick("a", "id", "s"), {"a": node("SAMPLE", tab("source"), n=20, by="s")})
    assert rows(again) == rows(strata)
    other = run(df, pick("a", "id", "s"), {"a": node("SAMPLE", tab("source"), n=20, by="s", seed=1)})
    assert rows(other) != rows(strata)
    same = spark.range(500).selectExpr("1 AS v")
    assert run(same, pick("a", "v"), {"a": node("SAMPLE", tab("source"), n=123)}).count() == 123
    assert run(same.limit(0), pick("a", "v"), {"a": node("SAMPLE", tab("source"), n=5)}).count() == 0


# ---- sketches ----------------------------------------------------------------------


def test_merged_sketches_keep_their_bounds(spark):
    df = spark.range(40_000).selectExpr("id % 4 AS g", "id % 9 AS h", "id % 10007 AS v", "CASE WHEN id % 3 = 0 THEN 'often' WHEN id % 5 = 0 THEN 'some' ELSE concat('rare', id) END AS word", "IF(id % 50 = 0, NULL, CAST(id AS DOUBLE)) AS d")
    steps = {
        "fine": node("GROUP_BY", tab("source"), by=["g", "h"], agg={"v": "sketch_distinct", "word": "sketch_top", "d": "sketch_quantiles"}),
        "all": node("GROUP_BY", step("fine"), by="g", agg={"v": "merge_distinct", "word": "merge_top", "d": "merge_quantiles"}),
        **{n: node("COPY", step("all"), column=n) for n in ("v", "word", "d")},
    }
    outputs = {"g": node("COPY", step("all"), column="g"), "n": node("SKETCH_VALUE", step("v"), kind="distinct"), "top": node("SKETCH_VALUE", step("word"), kind="top", k=1), "q": node("SKETCH_VALUE", step("d"), kind="quantiles", q=0.9)}
    for r in run(df, outputs, steps).collect():
        assert abs(r.n - 10_000) < 0.06 * 10_000
        assert r.top[0].item == "often" and abs(r.top[0]["count"] - 3333) < 200
        assert 0.87 * 40_000 < r.q < 0.93 * 40_000
    nothing = run(df.limit(0), {"n": node("COPY", step("one"), column="v")}, {"one": node("GROUP_BY", tab("source"), by="g", agg={"v": "sketch_distinct"})})
    assert nothing.count() == 0
    near = run(df, pick("a", "v", "d"), {"a": node("GROUP_BY", tab("source"), by="g", agg={"v": "approx_nunique", "d": "approx_median"})})
    assert all(abs(r.v - 10_000) < 700 and abs(r.d - 20_000) < 400 for r in near.collect())


# ---- JSON and loops ----------------------------------------------------------------

TEXTS = ['{"k": 1, "name": "a", "tags": ["x", null, "yy"], "deep": {"z": [1, 2]}, "odd key": 2.5}', '{"k": "7", "tags": []}', "not json", None, "[1, 2]", '{"k": null, "tags": "text"}']


def test_json_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, j string")
    out = run(df, {"id": node("COPY", col("id")), "k": node("JSON_GET", col("j"), path="$.k", type="int"), "z": node("JSON_GET", col("j"), path="$.deep.z[1]", type="long"), "odd": node("JSON_GET", col("j"), path="$['odd key']", type="double")})
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [(1, 2, 2.5), (7, None, None), (None,) * 3, (None,) * 3, (None,) * 3, (None,) * 3]
    kinds = {f.name: f.dataType.simpleString() for f in inferred(df.where("id in (0, 1)"), "j").fields}
    assert kinds["name"] == "string" and kinds["tags"] == "array<string>" and kinds["k"] == "variant" and kinds["deep"].startswith("struct<z:array<")
    wide = run(df.where("id in (0, 1)"), pick("w", "id", "p_name"), {"w": node("EXPAND_JSON", tab("source"), column="j", prefix="p_")})
    assert rows(wide) == Counter([(0, "a"), (1, None)])
    given = run(df, pick("w", "id", "name"), {"w": node("EXPAND_JSON", tab("source"), column="j", fields={"name": "string"})})
    assert rows(given)[(0, "a")] == 1 and given.count() == 6
    assert inferred(df.where("id = 2"), "j").fields == [] and inferred(df.limit(0), "j").fields == []
    assert validate(read_plan({"output_mappings": {"x": node("JSON_GET", col("j"), path="k")}}), ["j"])


def value(spark, text, **cells):
    df = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in cells.items()))
    return df.select(parse(text, {c: F.col(c) for c in df.columns}).alias("v")).first().v


def test_loops(spark):
    xs = "array(3, NULL, -1, 8)"
    assert value(spark, "[x * 2 for x in xs if x > 0]", xs=xs) == [6, 16]
    assert value(spark, "any(x > 5 for x in xs)", xs=xs) is True and value(spark, "all(x > 5 for x in xs)", xs=xs) is False
    assert value(spark, "len(xs) + xs[0] + xs[-1]", xs=xs) == 15 and value(spark, "xs[9]", xs=xs) is None
    assert value(spark, "[x + y for x in xs if x != y]", xs="array(1, 2)", y="1") == [3]
    assert value(spark, "[[b + 1 for b in a] for a in xs]", xs="array(array(1), array(2, 3))") == [[2], [3, 4]]
    assert value(spark, "m['a'] + s['b']", m="map('a', 1)", s="named_struct('b', 2)") == 3
    assert value(spark, "json(j, '$.a.b', 'int') + 1", j="""'{"a": {"b": 4}}'""") == 5
    assert identifiers("[x + y for x in xs if x > z]") == {"y", "xs", "z"}
    for bad in ("[a for a in xs for b in xs]", "xs[True]", "xs[1:2]", "json(j, k)", "any(xs)", "[a async for a in xs]"):
        with pytest.raises(ExpressionError):
            value(spark, bad, xs=xs, j="'x'", k="'y'")


def test_totals_of_nulls_do_not_lower_the_mean(spark, tmp_path):
    """As in SQL, a client whose totals are all null counts neither as zero in the mean nor as a row above it."""
    from weftline.queries import QUERIES

    rows_in = [(1, 10.0), (2, 8.0), (3, 12.0), (3, None), (4, None), (5, None)]
    spark.createDataFrame(rows_in, "client_id long, total double").withColumn("status", F.lit("done")).write.parquet(str(tmp_path / "sales.parquet"))
    assert rows(QUERIES["shared_sub_plan"](spark, str(tmp_path))) == Counter([(3, 12.0)])
    sums = lambda **how: rows(run(spark.createDataFrame(rows_in, "g long, v double"), pick("s", "g", "v"), {"s": node("GROUP_BY", tab("source"), by="g", agg={"v": "sum"}, **how)}))
    assert sums(null_sum=True)[(4, None)] == 1 and sums()[(4, 0.0)] == 1
