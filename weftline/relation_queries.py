"""Queries of joins beyond equality, bag operators, grouping sets and frames over the shop's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .contracts import trust
from .graph import shared_folder
from .ontology import infer_model
from .operators import user
from .profiling import profile, statistics
from .queries import col, load, node, pick, query, run, step, tab
from .sources.readers import CsvSource, TableSource
from .sources.sinks import write_csv, write_table
from .streaming import stateful

# ---- joins by interval ---------------------------------------------------------------

_PERIODS_SQL = """SELECT change_id, client_id AS owner, valid_at, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at, seq, change_id) AS valid_to, segment
  FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL"""


def _periods(spark, sf):
    """Each change of a client with the time until which it holds."""
    w = Window.partitionBy("client_id").orderBy("valid_at", "seq", "change_id")
    return load(spark, sf, "client_changes").where("client_id IS NOT NULL AND valid_at IS NOT NULL").select("change_id", F.col("client_id").alias("owner"), "valid_at", F.lead("valid_at").over(w).alias("valid_to"), "segment")


def _meeting(name: str, operation: str, sql: str, left, right, outputs: tuple[str, ...], **options):
    @query(name, sql)
    def _(spark, sf):
        return run(left(spark, sf), pick("met", *outputs), {"met": node(operation, tab("source"), tab("other"), **options)}, {"other": right(spark, sf)})


_table = lambda name, *columns: lambda spark, sf: load(spark, sf, name).selectExpr(*columns)
_SALES = _table("sales", "sale_id", "client_id", "sold_at", "total")

_meeting(
    "range_join_point", "RANGE_JOIN", f"SELECT sale_id, change_id, segment FROM sales JOIN ({_PERIODS_SQL}) ON client_id = owner AND sold_at >= valid_at AND sold_at < valid_to",
    _SALES, _periods, ("sale_id", "change_id", "segment"), left_on="client_id", right_on="owner", left_start="sold_at", right_start="valid_at", right_end="valid_to", closed="left",
)
_meeting(
    "range_join_left", "RANGE_JOIN", f"SELECT sale_id, change_id FROM sales LEFT JOIN ({_PERIODS_SQL}) ON client_id = owner AND sold_at >= valid_at AND sold_at <= valid_to",
    _SALES, _periods, ("sale_id", "change_id"), left_on="client_id", right_on="owner", left_start="sold_at", right_start="valid_at", right_end="valid_to", how="left",
)
_BANDS_SQL = "SELECT vendor_id, balance - 1 AS low, balance + abs(balance) / 200 AS high FROM vendors"
_bands = lambda spark, sf: load(spark, sf, "vendors").select("vendor_id", (F.col("balance") - 1).alias("low"), (F.col("balance") + F.abs("balance") / 200).alias("high"))
_reach = lambda spark, sf: load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("low"), (F.col("c_acctbal") + F.col("c_nationkey")).alias("high"))
_meeting(
    "range_join_overlap", "RANGE_JOIN", f"SELECT c_custkey, vendor_id FROM customer JOIN ({_BANDS_SQL}) v ON c_acctbal <= v.high AND v.low <= c_acctbal + c_nationkey",
    _reach, _bands, ("c_custkey", "vendor_id"), left_start="low", left_end="high", right_start="low", right_end="high",
)
for _how, _word in (("left_semi", "EXISTS"), ("left_anti", "NOT EXISTS")):
    _meeting(
        f"range_join_{_how.removeprefix('left_')}", "RANGE_JOIN", f"SELECT c_custkey FROM customer WHERE {_word} (SELECT 1 FROM ({_BANDS_SQL}) v WHERE c_acctbal <= v.high AND v.low <= c_acctbal + c_nationkey)",
        _reach, _bands, ("c_custkey",), left_start="low", left_end="high", right_start="low", right_end="high", how=_how,
    )

# ---- nearest in time -----------------------------------------------------------------

_CLICKS = _table("clicks", "click_id", "client_id AS visitor", "ts")
_ONCE_SQL = "SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL"
_CHANGED_SQL = "SELECT client_id AS owner, valid_at, max(change_id) AS change_id FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY ALL"
_changes = _table("client_changes", "change_id", "client_id AS owner", "valid_at")
_meeting(
    "asof_join_backward", "ASOF_JOIN", f"SELECT s.sale_id, c.change_id FROM sales s ASOF LEFT JOIN ({_CHANGED_SQL}) c ON s.client_id = c.owner AND s.sold_at >= c.valid_at",
    _SALES, _changes, ("sale_id", "change_id"), left_on="client_id", right_on="owner", left_at="sold_at", right_at="valid_at",
)
_meeting(
    "asof_join_forward", "ASOF_JOIN", 
    f"SELECT k.click_id, s.sale_id FROM (SELECT click_id, client_id AS visitor, ts FROM clicks) k ASOF JOIN ({_ONCE_SQL}) s ON k.visitor = s.client_id AND k.ts < s.sold_at WHERE epoch_us(s.sold_at) - epoch_us(k.ts) <= 86400000000",
    _CLICKS, _SALES, ("click_id", "sale_id"), left_on="visitor", right_on="client_id", left_at="ts", right_at="sold_at", direction="forward", exact=False, tolerance=86_400, how="inner",
)
_meeting(
    "asof_join_nearest", "ASOF_JOIN",
    f"""SELECT s.sale_id, CASE WHEN b.change_id IS NOT NULL AND (f.change_id IS NULL OR epoch_us(s.sold_at) - epoch_us(b.valid_at) <= epoch_us(f.valid_at) - epoch_us(s.sold_at)) THEN b.change_id ELSE f.change_id END AS change_id
    FROM sales s ASOF LEFT JOIN ({_CHANGED_SQL}) b ON s.client_id = b.owner AND s.sold_at >= b.valid_at ASOF LEFT JOIN ({_CHANGED_SQL}) f ON s.client_id = f.owner AND s.sold_at <= f.valid_at""",
    _SALES, _changes, ("sale_id", "change_id"), left_on="client_id", right_on="owner", left_at="sold_at", right_at="valid_at", direction="nearest",
)
_meeting(
    "asof_join_whole", "ASOF_JOIN", "SELECT k.event_id, o.o_orderkey FROM events k ASOF LEFT JOIN (SELECT o_totalprice / 1000 AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON k.value >= o.at",
    _table("events", "event_id", "value"), lambda spark, sf: load(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("at")), ("event_id", "o_orderkey"), left_at="value", right_at="at",
)

# ---- any condition -------------------------------------------------------------------

_SUPPLIERS, _VENDORS = _table("supplier", "s_suppkey", "s_acctbal", "s_nationkey"), _table("vendors", "vendor_id", "balance", "nation_id")
_THETA = {"condition": "s_acctbal < balance and s_nationkey != nation_id"}
_THETA_SQL = "s_acctbal < balance AND s_nationkey <> nation_id"
_meeting("theta_join", "THETA_JOIN", f"SELECT s_suppkey, vendor_id FROM supplier JOIN vendors ON {_THETA_SQL}", _SUPPLIERS, _VENDORS, ("s_suppkey", "vendor_id"), **_THETA)
_meeting("theta_join_grid", "THETA_JOIN", "SELECT s_suppkey, item_id FROM supplier JOIN items ON s_acctbal < price * 2 AND s_nationkey > size", _SUPPLIERS, _table("items", "item_id", "price", "size"), ("s_suppkey", "item_id"), condition="s_acctbal < price * 2 and s_nationkey > size", broadcast_rows=0)
_meeting("theta_join_left", "THETA_JOIN", f"SELECT s_suppkey, vendor_id FROM supplier LEFT JOIN vendors ON s_acctbal > balance * 2 AND s_nationkey > nation_id", _SUPPLIERS, _VENDORS, ("s_suppkey", "vendor_id"), condition="s_acctbal > balance * 2 and s_nationkey > nation_id", how="left", broadcast_rows=0)
_meeting("theta_join_anti", "THETA_JOIN", f"SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM vendors WHERE {_THETA_SQL})", _SUPPLIERS, _VENDORS, ("s_suppkey",), how="left_anti", broadcast_rows=0, **_THETA)

# ---- bags ----------------------------------------------------------------------------

_PAIR_A, _PAIR_B = "SELECT flag, quantity, NULL::VARCHAR AS kind FROM sale_lines", "SELECT flag, quantity + 3 AS quantity, NULL::VARCHAR AS kind FROM sale_lines WHERE discount > 0.02"
for _name, _op, _all in (("intersect", "INTERSECT", False), ("intersect_all", "INTERSECT", True), ("except", "EXCEPT", False), ("except_all", "EXCEPT", True)):

    @query(f"{_name}_rows", f"{_PAIR_A} {_op}{' ALL' * _all} {_PAIR_B}")
    def _(spark, sf, op=_op, every=_all):
        a = load(spark, sf, "sale_lines").select("flag", "quantity")
        b = load(spark, sf, "sale_lines").where("discount > 0.02").select((F.col("quantity") + 3).alias("quantity"), F.lit(None).cast("string").alias("kind"), "flag")
        return run(a, pick("both", "flag", "quantity", "kind"), {"both": node(op, tab("source"), tab("b"), all=every)}, {"b": b})


# ---- grouping sets -------------------------------------------------------------------

_TOTALS = "status, priority, GROUPING(status, priority) AS level, count(*) AS n_size, round(sum(total), 2) AS total_sum"
for _name, _sets, _sql in (("cube", "cube", "CUBE (status, priority)"), ("rollup", "rollup", "ROLLUP (status, priority)"), ("grouping_sets", [["status"], ["priority"], []], "GROUPING SETS ((status), (priority), ())")):

    @query(f"group_by_{_name}", f"SELECT {_TOTALS} FROM (SELECT CASE WHEN sale_id % 7 <> 0 THEN status END AS status, CASE WHEN sale_id % 5 <> 0 THEN priority END AS priority, coalesce(total, 0) AS total FROM sales) GROUP BY {_sql}")
    def _(spark, sf, sets=_sets):
        df = load(spark, sf, "sales").select(F.when(F.col("sale_id") % 7 != 0, F.col("status")).alias("status"), F.when(F.col("sale_id") % 5 != 0, F.col("priority")).alias("priority"), F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(1).alias("n"))
        steps = {"sums": node("GROUP_BY", tab("source"), by=["status", "priority"], agg={"n": ["size"], "total": ["sum"]}, sets=sets, null_keys=True, grouping_id="level")}
        out = run(df, pick("sums", "status", "priority", "level", "n_size", "total_sum"), steps)
        return out.withColumn("total_sum", F.round("total_sum", 2))


@query("group_by_rollup_drops_null_keys", "SELECT status, priority, count(*) AS n FROM sales WHERE status IS NOT NULL AND priority IS NOT NULL GROUP BY ROLLUP (status, priority)")
def _(spark, sf):
    steps = {"sums": node("GROUP_BY", tab("source"), by=["status", "priority"], agg={"n": "size"}, sets="rollup")}
    return run(load(spark, sf, "sales").withColumn("n", F.lit(1)), pick("sums", "status", "priority", "n"), steps)


# ---- offsets, tiles and frames -------------------------------------------------------

_OVER = "OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id"
_ALL = "OVER (ORDER BY value NULLS LAST, event_id"


def _frame(name: str, sql: str, **options):
    @query(f"win_{name}", f"SELECT event_id, {sql} AS w FROM (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS v, value FROM events)")
    def _(spark, sf):
        df = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"), "value")
        steps = {"w": node("WINDOW_APPLY", tab("source"), **{"partition_by": ["user_id"], "target_column": "v", "order_by": "value", **options})}
        return run(df, {"event_id": node("COPY", col("event_id")), "w": node("COPY", step("w"))}, steps, row_id="event_id")


_held = lambda sql: f"CASE WHEN user_id IS NOT NULL THEN {sql} END"
_frame("lag", _held(f"lag(v, 2, -1.0) {_OVER})"), function="lag", offset=2, default=-1.0)
_frame("lead", _held(f"lead(v) {_OVER})"), function="lead")
_frame("ntile", _held(f"ntile(4) {_OVER})::INTEGER"), function="ntile", buckets=4)
_frame("rows_sum", _held(f"sum(event_id) {_OVER} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)::BIGINT"), function="sum", target_column="event_id", frame={"kind": "rows", "start": -3, "end": 1})
_frame("range_count", _held("count(v) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)"), function="count", frame={"kind": "range", "start": -5, "end": 0})
_frame("unbounded_max", _held(f"max(v) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"), function="max", frame={"kind": "rows", "end": -2})
_frame("all_lag", f"lag(v, 3, -1.0) {_ALL})", function="lag", offset=3, default=-1.0, partition_by=[])
_frame("all_lead", f"lead(v, 1) {_ALL})", function="lead", partition_by=[])
_frame("all_ntile", f"ntile(7) {_ALL})::INTEGER", function="ntile", buckets=7, partition_by=[])
_frame("all_rows_min", f"min(v) {_ALL} ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING)", function="min", partition_by=[], frame={"kind": "rows", "start": -4, "end": -2})
_frame("all_rows_sum", f"sum(event_id) {_ALL} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)::BIGINT", function="sum", target_column="event_id", partition_by=[], frame={"kind": "rows", "start": -10, "end": 10})
_frame("all_range_count", "count(v) OVER (ORDER BY value RANGE BETWEEN 1 PRECEDING AND 0.5 FOLLOWING)", function="count", partition_by=[], frame={"kind": "range", "start": -1.0, "end": 0.5})
_frame("all_range_sum", "sum(event_id) OVER (ORDER BY value DESC RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT", function="sum", target_column="event_id", ascending=False, partition_by=[], frame={"kind": "range", "start": -2.0, "end": 0.0})


# ---- subqueries and sub-plans --------------------------------------------------------

_BUYERS = _table("clients", "client_id", "nation_id", "balance")


def _sub(name: str, operation: str, sql: str, prepare=None, **options):
    @query(name, sql)
    def _(spark, sf):
        sales = load(spark, sf, "sales")
        sales = sales.selectExpr(*prepare) if prepare else sales
        return run(_BUYERS(spark, sf), pick("kept", "client_id", "balance"), {"kept": node(operation, tab("source"), tab("sales"), **options)}, {"sales": sales})


_sub("where_exists", "WHERE_EXISTS", "SELECT client_id, balance FROM clients c WHERE EXISTS (SELECT 1 FROM sales s WHERE s.client_id = c.client_id AND s.total > c.balance / 10)", ("client_id", "total"), on="client_id", condition="total > balance / 10")
_sub("where_not_exists", "WHERE_EXISTS", "SELECT client_id, balance FROM clients c WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.client_id = c.client_id AND s.total > c.balance / 10)", ("client_id", "total"), on="client_id", condition="total > balance / 10", negate=True)
_sub("where_in", "WHERE_IN", "SELECT client_id, balance FROM clients WHERE client_id IN (SELECT client_id FROM sales)", column="client_id")
_sub("where_not_in", "WHERE_IN", "SELECT client_id, balance FROM clients WHERE client_id NOT IN (SELECT coalesce(client_id, -1) * 2 FROM sales)", ("coalesce(client_id, -1) * 2 AS other",), column="client_id", sub_column="other", negate=True)
_sub(
    "where_not_in_correlated", "WHERE_IN", "SELECT client_id, balance FROM clients c WHERE nation_id NOT IN (SELECT s.priority FROM (SELECT client_id, CASE WHEN sale_id % 11 <> 0 THEN priority END AS priority FROM sales) s WHERE s.client_id = c.client_id)",
    ("client_id", "CASE WHEN sale_id % 11 <> 0 THEN priority END AS priority"), column="nation_id", sub_column="priority", on="client_id", negate=True,
)


@query("scalar_subquery", "SELECT client_id, (SELECT count(*) FROM sales s WHERE s.client_id = c.client_id) AS n_sales, (SELECT max(total) FROM sales s WHERE s.client_id = c.client_id) AS largest, (SELECT max(priority) FROM sales) AS highest FROM clients c")
def _(spark, sf):
    steps = {n: node("SCALAR_SUBQUERY", tab("source"), tab("sales"), column=c, agg=how, **on) for n, c, how, on in (("n", "sale_id", "size", {"on": "client_id"}), ("most", "total", "max", {"on": "client_id"}), ("top", "priority", "max", {}))}
    outputs = {"client_id": node("COPY", col("client_id")), "n_sales": node("COPY", step("n")), "largest": node("COPY", step("most")), "highest": node("COPY", step("top"))}
    return run(_BUYERS(spark, sf), outputs, steps, {"sales": load(spark, sf, "sales")})


@query(
    "shared_sub_plan",
    """WITH spent AS (SELECT client_id, sum(total) AS total FROM sales WHERE status = 'done' AND client_id IS NOT NULL GROUP BY 1), mean AS (SELECT 1 AS one, avg(total) AS average FROM spent)
    SELECT client_id, round(total, 2) AS total FROM spent WHERE total > (SELECT average FROM mean)""",
)
def _(spark, sf):
    from .plans.compiler import compile_plan
    from .plans.document import read_plan

    spent = {"intermediate_steps": {"done": node("FILTER", tab("source"), condition="status == 'done'"), "sums": node("GROUP_BY", step("done"), by="client_id", agg={"total": "sum"}, null_sum=True)}, "output_mappings": pick("sums", "client_id", "total"), "materialise": True}
    plan = {
        "sub_plans": {"spent": spent},
        "intermediate_steps": {"with_mean": node("THETA_JOIN", tab("spent"), tab("means"), condition="total > average")},
        "output_mappings": {"client_id": node("COPY", step("with_mean"), column="client_id"), "total": node("COPY", step("with_mean"), column="total")},
    }
    mean = {"source": "spent", "intermediate_steps": {"m": node("GROUP_BY", tab("ones"), by="one", agg={"total": "mean"})}, "output_mappings": {"average": node("COPY", step("m"), column="total")}}
    ones = {"source": "spent", "output_mappings": {"one": node("COPY", {"type": "LITERAL", "value": 1}), "total": node("COPY", col("total"))}}
    plan["sub_plans"] |= {"means": mean, "ones": ones}
    return compile_plan(read_plan(plan), load(spark, sf, "sales")).withColumn("total", F.round("total", 2))


# ---- samples -------------------------------------------------------------------------

_SAMPLED = "SELECT sale_id, status, md5('7|sample|' || sale_id) AS h FROM sales"


@query("sample_rows", f"SELECT sale_id, status FROM ({_SAMPLED}) ORDER BY h LIMIT 500")
def _(spark, sf):
    return run(load(spark, sf, "sales").select("sale_id", "status"), pick("some", "sale_id", "status"), {"some": node("SAMPLE", tab("source"), n=500, key="sale_id", seed=7)})


@query("sample_strata", f"SELECT sale_id, status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY h) AS rn FROM ({_SAMPLED})) WHERE rn <= 60")
def _(spark, sf):
    return run(load(spark, sf, "sales").select("sale_id", "status"), pick("some", "sale_id", "status"), {"some": node("SAMPLE", tab("source"), n=60, by="status", key="sale_id", seed=7)})


# ---- sketches ------------------------------------------------------------------------

_NEAR = "abs(estimate - exact) <= greatest(3, 0.08 * exact)"


@query("sketch_distinct", "SELECT kind, count(DISTINCT client_id) AS exact, true AS near FROM clicks WHERE kind IS NOT NULL GROUP BY kind")
def _(spark, sf):
    """Sketches by kind and day, merged by kind."""
    df = load(spark, sf, "clicks").select("kind", F.to_date("ts").alias("day"), "client_id").where("day IS NOT NULL")
    steps = {"daily": node("GROUP_BY", tab("source"), by=["kind", "day"], agg={"client_id": "sketch_distinct"}), "all": node("GROUP_BY", step("daily"), by="kind", agg={"client_id": "merge_distinct"}), "sketch": node("COPY", step("all"), column="client_id")}
    got = run(df, {"kind": node("COPY", step("all"), column="kind"), "estimate": node("SKETCH_VALUE", step("sketch"), kind="distinct")}, steps)
    exact = load(spark, sf, "clicks").where("kind IS NOT NULL").groupBy("kind").agg(F.count_distinct("client_id").alias("exact"))
    return got.join(exact, "kind").selectExpr("kind", "exact", f"{_NEAR} AS near")


@query("sketch_quantiles", "SELECT status, true AS near FROM sales WHERE status IS NOT NULL GROUP BY 1")
def _(spark, sf):
    """The merged sketch's median lies between the exact quantiles 0.45 and 0.55."""
    df = load(spark, sf, "sales").select("status", "priority", "total")
    steps = {"fine": node("GROUP_BY", tab("source"), by=["status", "priority"], agg={"total": "sketch_quantiles"}), "all": node("GROUP_BY", step("fine"), by="status", agg={"total": "merge_quantiles"}), "sketch": node("COPY", step("all"), column="total")}
    got = run(df, {"status": node("COPY", step("all"), column="status"), "median": node("SKETCH_VALUE", step("sketch"), kind="quantiles", q=0.5)}, steps)
    exact = df.where("status IS NOT NULL AND priority IS NOT NULL").groupBy("status").agg(F.percentile("total", 0.45).alias("lo"), F.percentile("total", 0.55).alias("hi"))
    return got.join(exact, "status").selectExpr("status", "median BETWEEN lo AND hi AS near")


@query("sketch_top", "SELECT flag, kind AS item, count(*) AS n FROM (SELECT flag, CASE WHEN quantity % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM sale_lines WHERE flag IS NOT NULL AND quantity IS NOT NULL) GROUP BY ALL")
def _(spark, sf):
    """Counts of few different values are exact."""
    df = load(spark, sf, "sale_lines").where("quantity IS NOT NULL").select("flag", "line_no", F.when(F.col("quantity") % 2 == 0, "even").otherwise("odd").alias("kind"))
    steps = {"fine": node("GROUP_BY", tab("source"), by=["flag", "line_no"], agg={"kind": "sketch_top"}), "all": node("GROUP_BY", step("fine"), by="flag", agg={"kind": "merge_top"}), "sketch": node("COPY", step("all"), column="kind")}
    got = run(df, {"flag": node("COPY", step("all"), column="flag"), "top": node("SKETCH_VALUE", step("sketch"), kind="top", k=5)}, steps)
    return got.select("flag", F.explode("top").alias("t")).select("flag", F.col("t.item").alias("item"), F.col("t.count").alias("n"))


# ---- JSON ----------------------------------------------------------------------------


@query("json_get", "SELECT click_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.device.os' AS os, CASE WHEN json_type(props, '$.tags') = 'ARRAY' THEN json_array_length(props, '$.tags') END::INTEGER AS n_tags FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS props FROM clicks)")
def _(spark, sf):
    steps = {"tags": node("JSON_GET", col("props"), path="$.tags", type="array<string>")}
    outputs = {"click_id": node("COPY", col("click_id")), "k": node("JSON_GET", col("props"), path="$.k", type="bigint"), "os": node("JSON_GET", col("props"), path="$.device.os"), "n_tags": node("COMPUTE_EXPR", formula="len(tags)")}
    return run(load(spark, sf, "clicks").select("click_id", "props"), outputs, steps)


@query("expand_json", "SELECT click_id, TRY_CAST(p->>'$.k' AS BIGINT) AS p_k, p->>'$.device.os' AS os FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS p FROM clicks)")
def _(spark, sf):
    steps = {"wide": node("EXPAND_JSON", tab("source"), column="props", prefix="p_"), "device": node("COPY", step("wide"), column="p_device")}
    steps["k"] = node("COPY", step("wide"), column="p_k")  # numbers and texts: a VARIANT
    return run(load(spark, sf, "clicks").select("click_id", "props"), {**pick("wide", "click_id"), "p_k": node("JSON_GET", step("k"), path="$", type="bigint"), "os": node("COMPUTE_EXPR", formula="device['os']")}, steps)


@query("loop_expr", "SELECT click_id, CASE WHEN list_contains(tags, 'a') THEN true WHEN len(list_filter(tags, lambda t: t IS NULL)) > 0 THEN NULL WHEN tags IS NOT NULL THEN false END AS has_a, list_transform(list_filter(tags, lambda t: t <> 'b'), lambda t: upper(t))::VARCHAR AS others, tags[1] AS first FROM (SELECT click_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract(props, '$.tags') AS VARCHAR[]) END AS tags FROM clicks)")
def _(spark, sf):
    steps = {"tags": node("JSON_GET", col("props"), path="$.tags", type="array<string>"), "rest": node("COMPUTE_EXPR", formula="[t.str.upper() for t in tags if t != 'b']")}
    outputs = {"click_id": node("COPY", col("click_id")), "has_a": node("COMPUTE_EXPR", formula="any(t == 'a' for t in tags)"), "others": node("COPY", step("rest")), "first": node("COMPUTE_EXPR", formula="tags[0]")}
    out = run(load(spark, sf, "clicks").select("click_id", "props"), outputs, steps)
    return out.withColumn("others", F.when(F.col("others").isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", "others"), F.lit("]"))))


# ---- functions of the user's own -----------------------------------------------------


def _spread_partial(values):
    known = values.dropna()
    return {"n": len(known), "low": float(known.min()) if len(known) else None, "high": float(known.max()) if len(known) else None}


def _spread_merge(states):
    known = [s for s in states if s["n"]]
    return {"n": sum(s["n"] for s in states), "low": min((s["low"] for s in known), default=None), "high": max((s["high"] for s in known), default=None)}


def _tags(batches):
    """A row for each word of an item's name."""
    for pdf in batches:
        words = pdf.assign(word=pdf["name"].str.split(" ")).explode("word")
        yield words[words["word"].notna()][["item_id", "word"]]


user.register_aggregate("spread", _spread_partial, _spread_merge, lambda s: s["high"] - s["low"] if s["n"] else None, "struct<n:bigint,low:double,high:double>", "double")
user.register_table_function("name_words", _tags, "item_id long, word string")


@query("user_aggregate", "SELECT client_id, max(total) - min(total) AS spread FROM sales WHERE client_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return run(load(spark, sf, "sales"), pick("s", "client_id", "spread"), {"s": node("AGGREGATE_BY", tab("source"), by="client_id", column="total", function="spread")})


@query("user_table_function", "SELECT item_id, unnest(string_split(name, ' ')) AS word FROM items")
def _(spark, sf):
    return run(load(spark, sf, "items"), pick("w", "item_id", "word"), {"w": node("APPLY_TABLE", tab("source"), columns=["item_id", "name"], function="name_words")})


# ---- whole reports, models and readers -----------------------------------------------


@query(
    "profile_report",
    """SELECT 'o_orderkey' AS column, 'numeric' AS kind, 0.0 AS null_ratio FROM orders HAVING count(*) > 0 UNION ALL SELECT 'o_orderpriority', 'string_or_categorical', 0.0 UNION ALL SELECT 'half', 'numeric', round((SELECT count(*) FILTER (o_orderkey % 2 = 0) / count(*) FROM orders), 4)""",
)
def _(spark, sf):
    """The profile of the whole table, a row a column."""
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderkey")).alias("half"))
    fields = profile(df, max_sample_rows=None)["fields"]
    return spark.createDataFrame([(c, f["logical_type"], f["null_ratio"]) for c, f in fields.items()], "column string, kind string, null_ratio double")


@query("approximate_statistics", "SELECT 'sale_id' AS column, count(*) AS rows, count(*) - count(sale_id) AS nulls, true AS near FROM sales UNION ALL SELECT 'client_id', count(*), count(*) - count(client_id), true FROM sales")
def _(spark, sf):
    """Sketched distinct counts lie within 8 % of the exact ones."""
    df = load(spark, sf, "sales").select("sale_id", "client_id")
    exact = df.agg(*(F.count_distinct(c).alias(c) for c in df.columns)).select(F.explode(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c))))).alias("column", "exact"))
    return statistics(df, exact=False).join(exact, "column").selectExpr("column", "rows", "nulls", "abs(distinct_values - exact) <= greatest(3, 0.08 * exact) AS near")


_RULES_SQL = lambda c, kind: f"SELECT '{c}' AS field, '{kind}' AS type, concat_ws(',', CASE WHEN min({c}) >= 0 THEN 'non_negative' END, CASE WHEN count({c}) = count(*) THEN 'not_null' END, CASE WHEN '{kind}' = 'int' AND count(DISTINCT {c}) = count(*) THEN 'unique' END) AS rules FROM customer"


@query("infer_model", " UNION ALL ".join(_RULES_SQL(c, k) for c, k in (("c_custkey", "int"), ("c_nationkey", "int"), ("c_acctbal", "float"))))
def _(spark, sf):
    model = infer_model(load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "customers")
    rules = model["odcs_contracts"]["row_level_rules"]
    rows = [(f, s["type"], ",".join(sorted(r["assertion"] for r in rules if r.get("column") == f))) for f, s in model["fields"].items()]
    return spark.createDataFrame(rows, "field string, type string, rules string")


@query("csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    """Written as CSV to the shared folder and read back as text."""
    path = f"{shared_folder(spark)}/csv/{uuid.uuid4().hex}"
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    back = CsvSource(spark, path, schema="c_custkey string, c_name string, c_mktsegment string").read()
    return back


@query(
    "contract_report",
    "SELECT 'not_null' AS rule, count(*) FILTER (client_id IS NULL) AS affected FROM sales HAVING count(*) FILTER (client_id IS NULL) > 0 UNION ALL SELECT 'non_negative', count(*) FILTER (total < 0) FROM sales HAVING count(*) FILTER (total < 0) > 0 UNION ALL SELECT 'range', count(*) FILTER (total > 100) FROM sales HAVING count(*) FILTER (total > 100) > 0",
)
def _(spark, sf):
    rules = [{"assertion": "not_null", "column": "client_id"}, {"assertion": "non_negative", "column": "total"}, {"assertion": "range", "column": "total", "max": 100}]
    report = trust.evaluate(load(spark, sf, "sales"), {"row_level_rules": rules}).report
    return spark.createDataFrame([(e.rule.split("(")[0], e.affected_rows) for e in report.errors], "rule string, affected long")


# ---- streams -------------------------------------------------------------------------


@query("stream_occurrences", "SELECT client_id, count(*) AS n FROM (SELECT DISTINCT client_id, sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    """Sales as a stream: each client's rows are numbered across micro-batches; the highest number is the client's count."""
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    table = load(spark, sf, "sales").select("sale_id", "client_id", "sold_at").dropDuplicates(["sale_id", "client_id"])
    table.repartition(2).write.parquet(f"{path}/in")
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    numbered = stateful.occurrences(feed, "client_id", "sold_at", late="3650 days", keep_hours=24 * 3650)
    stateful.run_once(numbered, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("client_id").agg(F.max("_occurrence").alias("n"))


@query("stream_repeats", "SELECT count(*) - count(DISTINCT vendor_id) AS repeats, count(*) AS n FROM sale_lines WHERE vendor_id IS NOT NULL AND shipped_at IS NOT NULL")
def _(spark, sf):
    """The rule ``unique`` over a stream of sale lines: all rows of a vendor but the first break it."""
    path = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    table = load(spark, sf, "sale_lines").select("sale_id", "vendor_id", "shipped_at")
    table.repartition(3).write.parquet(f"{path}/in")
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stateful.run_once(stateful.unique_rows(feed, "vendor_id", "shipped_at", late="3650 days", keep_hours=24 * 3650), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").agg(F.sum((F.size("_violations") > 0).cast("long")).alias("repeats"), F.count("*").alias("n"))


# ---- files, sinks and findings -------------------------------------------------------

for _form in ("orc", "json"):

    @query(f"{_form}_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
    def _(spark, sf, form=_form):
        path = f"{shared_folder(spark)}/{form}/{uuid.uuid4().hex}"
        load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.format(form).save(path)
        return TableSource(spark, path, form).read().select("s_suppkey", "s_name", "s_acctbal")


@query("table_sink", "SELECT p_partkey, p_brand, true AS stamped FROM part UNION ALL SELECT p_partkey, p_brand, true FROM part")
def _(spark, sf):
    """Two appends of a table, each stamped with its time."""
    path = f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}"
    parts = load(spark, sf, "part").select("p_partkey", "p_brand")
    for _ in range(2):
        write_table(parts, path, partition_by=["p_brand"])
    return spark.read.parquet(path).select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"), F.col("_compiled_at").isNotNull().alias("stamped"))


@query("csv_sink", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}"
    write_csv(load(spark, sf, "nation").select("n_nationkey", "n_name"), path, ";")
    return CsvSource(spark, path, delimiter=";", schema="n_nationkey string, n_name string").read()


@query("fallback_halt", "SELECT sale_id, CASE WHEN sale_id % 4 <> 0 THEN status END AS status FROM sales")
def _(spark, sf):
    """HALT and KEEP_NULL leave nulls to the contracts."""
    df = load(spark, sf, "sales").select("sale_id", F.when(F.col("sale_id") % 4 != 0, F.col("status")).alias("status"))
    return run(df, {"sale_id": node("COPY", col("sale_id")), "status": node("COPY", col("status"))}, fields={"sale_id": {}, "status": {"fallback_strategy": "HALT"}})


@query("unsupported_findings", "SELECT 'teleport' AS rule, 'unsupported assertion' AS note, count(*) AS n_rows FROM orders")
def _(spark, sf):
    """A rule of an unknown kind is noted and breaks nothing."""
    done = trust.evaluate(load(spark, sf, "orders"), {"row_level_rules": [{"assertion": "teleport", "column": "o_orderkey"}], "global_invariants": [{"type": "unheard_of"}]})
    report = done.report
    return spark.createDataFrame([(w.rule.split("(")[0], w.note, report.total_rows) for w in report.warnings], "rule string, note string, n_rows long")
