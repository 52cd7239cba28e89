"""Queries over the driver's tables, one or more for each operator, and their SQL.

Every query goes through the engine (plan documents, contracts, chaos); the SQL
states the same result independently. ``QUERIES`` and ``ORACLES`` share keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chaos import arena, corruptors, scenarios
from .contracts import trust
from .contracts.rules import Rule, Violations
from .ontology import inspect_schema
from .pipeline import failure_statistics
from .plans.compiler import compile_plan
from .plans.document import read_plan
from .profiling import concept_matches, correlations, statistics, top_values
from .review import error_matrix, review

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def col(name: str) -> dict:
    return {"type": "COLUMN_REF", "value": name}


def step(name: str) -> dict:
    return {"type": "STEP_REF", "value": name}


def val(v) -> dict:
    return {"type": "LITERAL", "value": v}


def tab(name: str) -> dict:
    return {"type": "TABLE_REF", "value": name}


def node(op: str, *inputs: dict, to: str = "string", **options) -> dict:
    return {"operation": op, "inputs": list(inputs), "target_type": to, "options": options}


def pick(of: str, *names: str) -> dict:
    """Outputs that copy columns of a table step."""
    return {n: node("COPY", step(of), column=n) for n in names}


def run(source: DataFrame, outputs: dict, steps: dict | None = None, tables: dict | None = None, **how) -> DataFrame:
    return compile_plan(read_plan({"intermediate_steps": steps or {}, "output_mappings": outputs}), source, tables, **how)


def scalar(name: str, table: str, key: str, outputs: dict, sql: str, prepare=None, **how) -> None:
    """A query of scalar outputs beside a key."""

    @query(name, sql)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        df = load(spark, sf, table)
        return run(prepare(df) if prepare else df, {key: node("COPY", col(key)), **outputs}, **how)


# ---- scalar operators ------------------------------------------------------------

_DIRTY = lambda: F.when(F.col("o_orderkey") % 7 == 0, F.lit(" nan ")).when(F.col("o_orderkey") % 11 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t")))
_DIRTY_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN ' nan ' WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE '  ' || o_orderpriority || chr(9) END"
scalar(
    "copy_clean", "orders", "o_orderkey", {"priority": node("COPY", col("dirty"))},
    f"""SELECT o_orderkey, CASE WHEN s IN ('nan', 'N/A') THEN NULL ELSE s END AS priority
    FROM (SELECT o_orderkey, regexp_replace({_DIRTY_SQL}, '^\\s+|\\s+$', '', 'g') AS s FROM orders)""",
    lambda d: d.withColumn("dirty", _DIRTY()),
)
scalar(
    "concat", "customer", "c_custkey", {"label": node("CONCAT", col("c_name"), col("seg"))},
    "SELECT c_custkey, c_name || CASE WHEN c_custkey % 5 = 0 THEN '<NA>' ELSE c_mktsegment END AS label FROM customer",
    lambda d: d.withColumn("seg", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))),
)
_HOLES = lambda d: d.withColumn("price", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))).withColumn("text", F.when(F.col("o_orderkey") % 4 == 0, F.lit("1d")).when(F.col("o_orderkey") % 4 == 1, F.lit(" 12 ")).when(F.col("o_orderkey") % 4 == 2, F.lit("-1.5e1")).otherwise(F.lit("x")))
_PRICE = "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0.0 END"
_TEXT = "CASE o_orderkey % 4 WHEN 1 THEN 12.0 WHEN 2 THEN -15.0 END"
scalar(
    "add_sub", "orders", "o_orderkey", {"plus": node("ADD", col("price"), col("text")), "minus": node("SUBTRACT", col("price"), col("text"))},
    f"SELECT o_orderkey, {_PRICE} + coalesce({_TEXT}, 0.0)::DOUBLE AS plus, {_PRICE} - coalesce({_TEXT}, 0.0)::DOUBLE AS minus FROM orders", _HOLES,
)
scalar("multiply", "orders", "o_orderkey", {"product": node("MULTIPLY", col("price"), val(3))}, f"SELECT o_orderkey, {_PRICE} * 3.0::DOUBLE AS product FROM orders", _HOLES)
scalar(
    "divide_guard", "orders", "o_orderkey", {"ratio": node("DIVIDE", col("price"), col("by"))},
    f"SELECT o_orderkey, {_PRICE} / (CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 5)::DOUBLE END)::DOUBLE AS ratio FROM orders",
    lambda d: _HOLES(d).withColumn("by", F.when(F.col("o_orderkey") % 5 != 4, F.col("o_orderkey") % 5)),
)
scalar("to_float", "orders", "o_orderkey", {"number": node("TO_FLOAT", col("text"))}, f"SELECT o_orderkey, ({_TEXT})::DOUBLE AS number FROM orders", _HOLES)
scalar("to_int", "orders", "o_orderkey", {"number": node("TO_INT", col("price"))}, f"SELECT o_orderkey, trunc({_PRICE})::BIGINT AS number FROM orders", _HOLES)
scalar(
    "parse_date", "orders", "o_orderkey", {"day": node("PARSE_DATE", col("text")), "same": node("PARSE_DATE", col("o_orderdate"))},
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%Y-%m-%d') AS same FROM orders""",
    lambda d: d.withColumn("text", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))),
)
scalar(
    "clean_currency", "part", "p_partkey", {"price": node("CLEAN_CURRENCY", col("text"))},
    "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size * 1000.0 + 0.5 END::DOUBLE AS price FROM part",
    lambda d: d.withColumn("text", F.when(F.col("p_partkey") % 6 == 0, F.lit("free")).otherwise(F.concat(F.lit("RM "), F.col("p_size").cast("string"), F.lit(",000.50 MYR")))),
)
scalar(
    "fuzzy_map", "customer", "c_custkey", {"segment": node("FUZZY_MAP", col("text"), mapping_dict={"BUILDING": "BLD", "MACHINERY": "MCH"})},
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD' WHEN 'MACHINERY' THEN 'MCH' ELSE c_mktsegment END AS segment FROM customer",
    lambda d: d.withColumn("text", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))),
)
scalar(
    "regex_extract", "customer", "c_custkey", {"tail": node("REGEX_EXTRACT", col("c_name"), pattern=r"#0*(?P<n>[1-9]\d*5)$")},
    "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*([1-9][0-9]*5)$') THEN regexp_extract(c_name, '#0*([1-9][0-9]*5)$', 1) END AS tail FROM customer",
)
scalar(
    "replace", "part", "p_partkey", {"swapped": node("REPLACE", col("p_name"), pattern=r"^(\w+) (\w+)", replacement=r"\2-\1"), "plain": node("REPLACE", col("p_type"), pattern="A.", replacement="$", is_regex=False)},
    "SELECT p_partkey, regexp_replace(p_name, '^([0-9A-Za-z_]+) ([0-9A-Za-z_]+)', '\\2-\\1') AS swapped, replace(p_type, 'A.', '$') AS plain FROM part",
)
_LINES = "SELECT event_id, user_id, value, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events"
_EVENT_HOLES = lambda d: d.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
scalar("fillna_value", "events", "event_id", {"filled": node("FILLNA", col("v"), value=-1.0)}, f"SELECT event_id, coalesce(v, -1.0)::DOUBLE AS filled FROM ({_LINES})", _EVENT_HOLES)
scalar(
    "fillna_ffill", "events", "event_id", {"filled": node("FILLNA", col("v"), method="ffill")},
    f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM ({_LINES})", _EVENT_HOLES, row_id="event_id",
)
scalar(
    "fillna_bfill", "events", "event_id", {"filled": node("FILLNA", col("v"), method="bfill")},
    f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM ({_LINES})", _EVENT_HOLES, row_id="event_id",
)
scalar(
    "fillna_ffill_partitioned", "events", "event_id", {"filled": node("FILLNA", col("v"), method="ffill", partition_by=["user_id"])},
    f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM ({_LINES})", _EVENT_HOLES, row_id="event_id",
)
scalar(
    "compute_expr", "part", "p_partkey", {"total": node("COMPUTE_EXPR", formula="abs(p_retailprice - 1000) * 2 + p_size % 7 - p_size // 3"), "flag": node("COMPUTE_EXPR", formula="10 < p_size <= 30 & ~(p_brand in ['Brand#11', 'Brand#12'])")},
    """SELECT p_partkey, abs(p_retailprice - 1000) * 2 + (p_size % 7)::DOUBLE - floor(p_size / 3) AS total,
    (10 < p_size AND p_size <= 30 AND NOT p_brand IN ('Brand#11', 'Brand#12')) AS flag FROM part""",
)


@query(
    "compute_steps",
    "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_size * 10.0)::DOUBLE * 0.06 END AS tax FROM part",
)
def _(spark, sf):
    df = load(spark, sf, "part").withColumn("amount_str", F.when(F.col("p_partkey") % 6 == 0, F.lit("-")).otherwise(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("0"))))
    steps = {"tax_step": node("COMPUTE_EXPR", formula="step_clean_num * 0.06"), "step_clean_num": node("CLEAN_CURRENCY", col("amount_str"))}
    return run(df, {"p_partkey": node("COPY", col("p_partkey")), "tax": node("COPY", step("tax_step"), to="float")}, steps)


scalar(
    "case_when", "part", "p_partkey",
    {"band": node("CASE_WHEN", cases=[{"condition": "p_size < 10", "value": "small"}, {"condition": "p_size < 30", "value": "middle"}], default="large"),
     "who": node("CASE_WHEN", cases=[{"condition": "p_size > 25", "value": "p_brand"}, {"condition": "p_size > 45", "value": "never"}]),
     "twice": node("CASE_WHEN", col("p_size"), cases=[{"condition": "_temp > 25", "value": 2.0}], default=1.0)},
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band,
    CASE WHEN p_size > 25 THEN p_brand END AS who, CASE WHEN p_size > 25 THEN 2.0 ELSE 1.0 END::DOUBLE AS twice FROM part""",
)
scalar("literal", "region", "r_regionkey", {"source": node("COPY", val("erp")), "n": node("COPY", val(7))}, "SELECT r_regionkey, 'erp' AS source, 7::INTEGER AS n FROM region")
_FIELDS = lambda **f: {"fields": {"o_orderkey": {"type": "int"}, **f}}
scalar("fallback_zero", "orders", "o_orderkey", {"price": node("COPY", col("price"))}, f"SELECT o_orderkey, {_PRICE} AS price FROM orders", _HOLES, **_FIELDS(price={"fallback_strategy": "USE_ZERO"}))
scalar(
    "fallback_default", "orders", "o_orderkey", {"status": node("COPY", col("status"))},
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS status FROM orders",
    lambda d: d.withColumn("status", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))), **_FIELDS(status={"fallback_strategy": "DEFAULT_STRING"}),
)
scalar(
    "anchor_int", "part", "p_partkey", {"size": node("COPY", col("text"), to="int"), "price": node("COPY", col("p_retailprice"), to="float")},
    "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END::BIGINT AS size, p_retailprice AS price FROM part",
    lambda d: d.withColumn("text", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).otherwise(F.lit("?"))),
)


@query("resolve_entities")
def _(spark, sf):
    noisy = corruptors.human_noise(load(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 0.1, columns=["p_name"])
    return run(noisy, {"p_partkey": node("COPY", col("p_partkey")), "p_name": node("RESOLVE_ENTITIES", col("p_name"), similarity_threshold=0.85)}, row_id="p_partkey")


# ---- tables -----------------------------------------------------------------------


@query("filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_nationkey = 7")
def _(spark, sf):
    steps = {"kept": node("FILTER", tab("source"), condition="c_acctbal < 0 and c_mktsegment in ['BUILDING', 'FURNITURE'] or c_nationkey == 7")}
    return run(load(spark, sf, "customer"), pick("kept", "c_custkey", "c_acctbal"), steps)


@query("align_filtered", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal END AS debt FROM customer")
def _(spark, sf):
    steps = {"kept": node("FILTER", tab("source"), condition="c_acctbal < 0")}
    return run(load(spark, sf, "customer"), {"c_custkey": node("COPY", col("c_custkey")), "debt": node("COPY", step("kept"), column="c_acctbal")}, steps)


def _join(name: str, sql: str, outputs: tuple[str, ...], prepare=None, left="customer", right="orders", **options):
    @query(name, sql)
    def _(spark, sf):
        a, b = load(spark, sf, left), load(spark, sf, right)
        if prepare:
            a, b = prepare(a, b)
        return run(a, pick("joined", *outputs), {"joined": node("JOIN", tab("source"), tab("other"), **options)}, {"other": b})


_join("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", ("c_custkey", "o_orderkey"), how="left", left_on="c_custkey", right_on="o_custkey")
_join("join_inner", "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", ("c_name", "o_orderkey", "o_totalprice"), how="inner", left_on=["c_custkey"], right_on=["o_custkey"])
_join(
    "join_outer", "SELECT c_custkey AS k, c_name, s_name FROM customer FULL JOIN (SELECT s_suppkey * 20 AS k, s_name FROM supplier) ON c_custkey = k WHERE c_custkey IS NOT NULL UNION ALL SELECT k, NULL, s_name FROM (SELECT s_suppkey * 20 AS k, s_name FROM supplier) WHERE k NOT IN (SELECT c_custkey FROM customer)", ("k", "c_name", "s_name"),
    lambda a, b: (a.select(F.col("c_custkey").alias("k"), "c_name"), b.select((F.col("s_suppkey") * 20).alias("k"), "s_name")), right="supplier", how="outer", on="k",
)
_join("join_right", "SELECT o_orderkey, c_name FROM (SELECT c_name, CASE WHEN c_acctbal > 0 THEN c_custkey END AS c_custkey FROM customer) RIGHT JOIN orders ON c_custkey = o_custkey", ("o_orderkey", "c_name"), lambda a, b: (a.select("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("c_custkey")), b), how="right", left_on="c_custkey", right_on="o_custkey")
_join("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", ("n_name", "r_name"), left="nation", right="region", how="cross")
_join("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", ("c_custkey", "c_name"), how="left_semi", left_on="c_custkey", right_on="o_custkey")
_join("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 3 FROM orders)", ("c_custkey", "c_name"), lambda a, b: (a, b.withColumn("o_custkey", F.col("o_custkey") * 3)), how="left_anti", left_on="c_custkey", right_on="o_custkey")
_join(
    "join_null_keys", "SELECT a.name AS name_x, b.name AS name_y FROM (SELECT CASE WHEN n_nationkey > 3 THEN n_regionkey END AS k, n_name AS name FROM nation) a JOIN (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END AS k, r_name AS name FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    ("name_x", "name_y"),
    lambda a, b: (a.select(F.when(F.col("n_nationkey") > 3, F.col("n_regionkey")).alias("k"), F.col("n_name").alias("name")), b.select(F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).alias("k"), F.col("r_name").alias("name"))),
    left="nation", right="region", how="inner", on="k",
)
for _distinct, _word in ((True, "UNION"), (False, "UNION ALL")):

    @query(f"union_{'distinct' if _distinct else 'all'}", f"SELECT c_nationkey AS nationkey, NULL::VARCHAR AS extra FROM customer {_word} SELECT s_nationkey, 'supplier' FROM supplier")
    def _(spark, sf, distinct=_distinct):
        a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
        b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("extra"))
        return run(a, pick("all", "nationkey", "extra"), {"all": node("UNION", tab("source"), tab("b"), distinct=distinct)}, {"b": b})


@query("explode", "SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def _(spark, sf):
    steps = {"words": node("EXPLODE", tab("source"), column="p_name", delimiter=" ")}
    return run(load(spark, sf, "part"), {"p_partkey": node("COPY", step("words"), column="p_partkey"), "word": node("COPY", step("words"), column="p_name")}, steps)


@query(
    "pivot",
    """SELECT l_returnflag, CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) END AS F,
    CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) END AS O FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    steps = {"wide": node("PIVOT", tab("source"), index="l_returnflag", columns="l_linestatus", values="l_quantity", pivot_values=["F", "O"])}
    return run(load(spark, sf, "lineitem"), pick("wide", "l_returnflag", "F", "O"), steps)


@query("unpivot", "SELECT s_suppkey, 's_acctbal' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::DOUBLE FROM supplier")
def _(spark, sf):
    steps = {"long": node("UNPIVOT", tab("source"), id_vars=["s_suppkey"], value_vars=["s_acctbal", "s_nationkey"])}
    return run(load(spark, sf, "supplier"), pick("long", "s_suppkey", "variable", "value"), steps)


@query("group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, count(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    steps = {"sums": node("GROUP_BY", tab("source"), by=["l_returnflag", "l_linestatus"], agg={"l_quantity": "sum", "l_partkey": "count"})}
    return run(load(spark, sf, "lineitem"), pick("sums", "l_returnflag", "l_linestatus", "l_quantity", "l_partkey"), steps)


@query(
    "group_by_multi",
    """SELECT user_id, avg(event_id) AS event_id_mean, min(value) AS value_min, max(value) AS value_max, median(value) AS value_median, count(DISTINCT event_type) AS event_type_nunique,
    min_by(value, event_id) AS value_first, max_by(value, event_id) AS value_last FROM (SELECT event_id, CASE WHEN user_id <> 5 THEN user_id END AS user_id, event_type, value FROM events) WHERE user_id IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    df = load(spark, sf, "events").withColumn("user_id", F.when(F.col("user_id") != 5, F.col("user_id")))
    steps = {"sums": node("GROUP_BY", tab("source"), by="user_id", agg={"event_id": ["mean"], "value": ["min", "max", "median", "first", "last"], "event_type": ["nunique"]})}
    return run(df, pick("sums", "user_id", "event_id_mean", "value_min", "value_max", "value_median", "event_type_nunique", "value_first", "value_last"), steps, row_id="event_id")


@query("group_by_spread", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(var_samp(l_quantity), 6) AS l_quantity_var, count(*) AS l_quantity_size, round(product(1 + l_tax / 1000), 6) AS growth_prod FROM lineitem GROUP BY 1")
def _(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("growth", 1 + F.col("l_tax") / 1000)
    steps = {"spread": node("GROUP_BY", tab("source"), by="l_returnflag", agg={"l_quantity": ["std", "var", "size"], "growth": ["prod"]})}
    out = run(df, pick("spread", "l_returnflag", "l_quantity_std", "l_quantity_var", "l_quantity_size", "growth_prod"), steps)
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity_std", "l_quantity_var", "growth_prod")})


def _window(name: str, sql: str, **options):
    @query(name, f"SELECT event_id, {sql} AS w FROM (SELECT event_id, value, event_type, CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events)")
    def _(spark, sf):
        df = load(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 10 != 0, F.col("value"))).withColumn("user_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id")))
        steps = {"w": node("WINDOW_APPLY", tab("source"), **{"partition_by": ["user_id"], "target_column": "v", **options})}
        return run(df, {"event_id": node("COPY", col("event_id")), "w": node("COPY", step("w"))}, steps, row_id="event_id")


_OVER = "OVER (PARTITION BY user_id"
_window("win_row_number", f"CASE WHEN user_id IS NOT NULL THEN row_number() {_OVER} ORDER BY value DESC NULLS LAST, event_id) END", function="row_number", order_by=["value"], ascending=False)
_window("win_rank", f"CASE WHEN user_id IS NOT NULL AND v IS NOT NULL THEN rank() {_OVER} ORDER BY v NULLS LAST) END::DOUBLE", function="rank")
_window("win_dense_rank", f"CASE WHEN user_id IS NOT NULL THEN dense_rank() {_OVER} ORDER BY event_type DESC) END::DOUBLE", function="dense_rank", target_column="event_type", ascending=False)
_window("win_mean", f"CASE WHEN user_id IS NOT NULL THEN avg(v) {_OVER}) END", function="mean")
_window("win_max", f"CASE WHEN user_id IS NOT NULL THEN max(v) {_OVER}) END", function="max")
_window("win_min", f"CASE WHEN user_id IS NOT NULL THEN min(v) {_OVER}) END", function="min")
_window("win_sum", f"CASE WHEN user_id IS NOT NULL THEN sum(event_id) {_OVER}) END::BIGINT", function="sum", target_column="event_id")
_window("win_cumsum", f"CASE WHEN user_id IS NOT NULL THEN sum(event_id) {_OVER} ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) END::BIGINT", function="cumulative_sum", target_column="event_id", order_by="value")


_window("win_all_row_number", "row_number() OVER (ORDER BY value DESC NULLS LAST, event_id)", function="row_number", order_by=["value"], ascending=False, partition_by=[])
_window("win_all_cumsum", "sum(event_id) OVER (ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT", function="cumulative_sum", target_column="event_id", order_by="value", partition_by=[])
_window("win_all_rank", "CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST) END::DOUBLE", function="rank", partition_by=[])
_window("win_all_dense_rank", "(dense_rank() OVER (ORDER BY event_type DESC))::DOUBLE", function="dense_rank", target_column="event_type", ascending=False, partition_by=[])
_window("win_all_sum", "(SELECT sum(event_id)::BIGINT FROM events)", function="sum", target_column="event_id", partition_by=[])
_window("win_all_mean", "(SELECT avg(event_id) FROM events)", function="mean", target_column="event_id", partition_by=[])
_window("win_all_min", "(SELECT min(value) FROM events WHERE event_id % 10 <> 0)", function="min", partition_by=[])
_window("win_all_max", "(SELECT max(value) FROM events WHERE event_id % 10 <> 0)", function="max", partition_by=[])


@query("align_positional", "SELECT a.n_nationkey, r_name FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name DESC) AS i FROM region) b ON a.i = b.i")
def _(spark, sf):
    steps = {"own": node("ORDER_BY", tab("source"), by="n_nationkey", reset_index=False), "names": node("ORDER_BY", tab("region"), by="r_name", ascending=False, reset_index=False)}
    outputs = {"n_nationkey": node("COPY", step("own"), column="n_nationkey"), "r_name": node("COPY", step("names"), column="r_name")}
    return run(load(spark, sf, "nation"), outputs, steps, {"region": load(spark, sf, "region")}, positional=True)


@query("order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    steps = {"sorted": node("ORDER_BY", tab("source"), by=["o_totalprice", "o_orderkey"], ascending=[False, True], reset_index=False), "top": node("LIMIT", step("sorted"), n=25)}
    return run(load(spark, sf, "orders"), pick("top", "o_orderkey", "o_totalprice"), steps, row_id="o_orderkey")


@query("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40")
def _(spark, sf):
    return run(load(spark, sf, "orders"), pick("top", "o_orderkey"), {"top": node("LIMIT", tab("source"), n=40)}, row_id="o_orderkey")


# ---- contracts ----------------------------------------------------------------------

_ORDERS = lambda spark, sf: load(spark, sf, "orders").select(
    "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", (F.col("o_totalprice") - 1000).alias("net"), "o_orderdate",
    F.when(F.col("o_orderkey") % 50 == 0, F.lit("a,b")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    F.when(F.col("o_orderkey") % 8 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 12).cast("int") - 6)).alias("shipped"), (F.col("o_orderkey") % 1000).alias("bucket"),
    (F.col("o_totalprice") - 150_000).alias("margin"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 10_000_000).otherwise(0)).alias("buyer"),
)
_ORDERS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice - 1000 AS net, o_orderdate,
  CASE WHEN o_orderkey % 50 = 0 THEN 'a,b' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate::DATE + (o_orderkey % 12 - 6)::INTEGER END AS shipped, o_orderkey % 1000 AS bucket,
  o_totalprice - 150000 AS margin, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 10000000 ELSE 0 END END AS buyer FROM orders"""


def _rule(name: str, where: str, rule: dict, reference: Callable | None = None):
    """Keys of the rows that break one rule."""

    @query(f"rule_{name}", f"SELECT o_orderkey FROM ({_ORDERS_SQL}) t WHERE {where}")
    def _(spark, sf):
        v = Violations(_ORDERS(spark, sf), [Rule.of(rule)], reference(spark, sf) if reference else None)
        return v.flagged().where(F.size("_violations") > 0).select("o_orderkey")


_rule("not_null", "o_custkey IS NULL", {"assertion": "not_null", "column": "o_custkey"})
_rule("non_negative", "margin < 0", {"assertion": "non_negative", "column": "margin"})
_rule("range", "net < 500 OR net > 300000", {"assertion": "range", "column": "net", "min": 500, "max": 300000})
_rule("max_length", "length(o_orderpriority) > 6", {"assertion": "max_length", "column": "o_orderpriority", "max_length": 6})
_rule("atomic", "o_orderpriority LIKE '%,%'", {"assertion": "atomic", "column": "o_orderpriority", "forbidden_delimiter": ","})
_rule("enum_match", "o_orderstatus NOT IN ('F', 'O')", {"assertion": "enum_match", "column": "o_orderstatus", "allowed_values": ["F", "O"]})
_rule("foreign_key", "buyer IS NOT NULL AND buyer NOT IN (SELECT c_custkey FROM customer)", {"assertion": "foreign_key", "column": "buyer", "target_entity": "customer"}, lambda spark, sf: {"customer": load(spark, sf, "customer").select("c_custkey")})
_rule("foreign_key_unknown", "o_custkey IS NOT NULL", {"assertion": "foreign_key", "column": "o_custkey", "target_entity": "nobody"})
_rule("pattern", "NOT regexp_matches(o_orderpriority, '^[1-3]')", {"assertion": "pattern", "column": "o_orderpriority", "regex": "^[1-3]"})
_rule("unique", f"o_custkey IS NULL OR o_custkey IN (SELECT o_custkey FROM ({_ORDERS_SQL}) GROUP BY 1 HAVING count(*) > 1)", {"assertion": "unique", "column": "o_custkey"})
_rule("cross_field", "shipped IS NOT NULL AND NOT shipped >= o_orderdate", {"assertion": "cross_field", "column": "shipped", "operator": ">=", "target_column": "o_orderdate"})
_rule("expression", "NOT coalesce(net * 2 > 100000 OR o_custkey > 700, false)", {"assertion": "expression", "formula": "net * 2 > 100000 or o_custkey > 700"})
_rule("expression_unknown", "true", {"assertion": "expression", "formula": "nothing > 1"})
_rule("date_tolerance", "abs(date_diff('day', o_orderdate::DATE, shipped)) > 3", {"assertion": "date_tolerance", "column": "shipped", "target_column": "o_orderdate", "tolerance_window_days": 3})

_CONTRACT = {
    "row_level_rules": [
        {"assertion": "not_null", "column": "o_custkey"},
        {"assertion": "non_negative", "column": "net", "severity": "warning", "tolerance_ratio": 0.5},
        {"assertion": "enum_match", "column": "o_orderstatus", "allowed_values": ["F", "O"], "severity": "warning", "tolerance_ratio": 0.01},
    ],
    "dataset_level_rules": [{"metric": "volume_check", "min_rows": 1}],
}
_BAD = "(o_custkey IS NULL OR o_orderstatus NOT IN ('F', 'O'))"


@query("route_clean", f"SELECT o_orderkey, net FROM ({_ORDERS_SQL}) t WHERE NOT {_BAD}")
def _(spark, sf):
    return trust.evaluate(_ORDERS(spark, sf), _CONTRACT).clean.select("o_orderkey", "net")


@query("route_quarantine", f"SELECT o_orderkey, net FROM ({_ORDERS_SQL}) t WHERE {_BAD}")
def _(spark, sf):
    return trust.evaluate(_ORDERS(spark, sf), _CONTRACT).quarantine.select("o_orderkey", "net")


@query(
    "trust_score",
    f"""SELECT n AS total_rows, q AS quarantined, w AS warned, CAST(round(greatest(0, 1 - q / n - 0.2 * w / n) * 10000) AS BIGINT) AS score_e4,
    CASE WHEN greatest(0, 1 - q / n - 0.2 * w / n) >= 0.8 THEN 'AUTO_HEAL' ELSE 'QUARANTINE' END AS decision
    FROM (SELECT count(*) AS n, count(*) FILTER ({_BAD}) AS q, count(*) FILTER (net < 0) AS w FROM ({_ORDERS_SQL}) t)""",
)
def _(spark, sf):
    r = trust.evaluate(_ORDERS(spark, sf), _CONTRACT).report
    row = (r.total_rows, r.quarantined_rows_count, sum(w.affected_rows for w in r.warnings), round(r.trust_score * 10000), r.routing_decision)
    return spark.createDataFrame([row], "total_rows long, quarantined long, warned long, score_e4 long, decision string")


def _dataset(name: str, sql: str, contracts: dict, table: Callable | None = None):
    """Names of the dataset checks that fail."""

    @query(name, sql)
    def _(spark, sf):
        df = table(spark, sf) if table else load(spark, sf, "orders")
        r = trust.evaluate(df, contracts, {"customer": load(spark, sf, "customer").select("c_custkey")}).report
        return spark.createDataFrame([(e["rule"],) for e in r.dataset_errors] or [], "rule string")


_dataset("ds_volume", "SELECT 'volume_check' AS rule FROM orders HAVING count(*) < 100000000", {"dataset_level_rules": [{"metric": "volume_check", "min_rows": 100_000_000}]})
_dataset(
    "ds_sum_alignment", "SELECT 'sum_alignment' AS rule FROM orders HAVING abs(sum(o_totalprice) - 5) > 0.00500001",
    {"dataset_level_rules": [{"metric": "sum_alignment", "target_sum_column": "o_totalprice", "expected_sum": 5.0}, {"metric": "sum_alignment", "target_sum_column": "absent", "expected_sum": 5.0}]},
)
_LEDGER = lambda spark, sf: load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("debit"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("credit"), F.col("l_partkey").alias("product_id"), (F.col("l_quantity") - 20).alias("quantity"))
_dataset("inv_double_entry", "SELECT 'double_entry' AS rule FROM lineitem HAVING abs(sum(l_extendedprice) - sum(l_extendedprice * (1 + l_tax))) > 1e-8 + 1e-6 * abs(sum(l_extendedprice * (1 + l_tax)))", {"global_invariants": [{"type": "double_entry", "rule": "sum(debit) == sum(credit)"}]}, _LEDGER)
_dataset("inv_line_sum", "SELECT 'line_sum_consistency' AS rule FROM lineitem HAVING NOT bool_and(l_extendedprice * (1 + l_tax) > l_extendedprice)", {"global_invariants": [{"type": "line_sum_consistency", "rule": "credit > debit"}]}, _LEDGER)
_dataset("inv_inventory", "SELECT DISTINCT 'inventory_non_negative' AS rule FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity - 20) < 0)", {"global_invariants": [{"type": "inventory_non_negative"}]}, _LEDGER)
_dataset("inv_custom", "SELECT 'custom' AS rule FROM lineitem HAVING NOT bool_and(l_quantity - 20 > 0)", {"global_invariants": [{"type": "custom", "rule": "quantity > 0"}]}, _LEDGER)


@query("inv_negative_stock", "SELECT l_partkey AS product_id, sum(l_quantity - 20) AS total FROM lineitem GROUP BY 1 HAVING sum(l_quantity - 20) < 0")
def _(spark, sf):
    return trust.negative_stock(_LEDGER(spark, sf))


@query("ds_orphan_rate", f"SELECT count(*) FILTER (buyer NOT IN (SELECT c_custkey FROM customer)) AS orphans, count(buyer) AS total, count(*) FILTER (buyer NOT IN (SELECT c_custkey FROM customer)) / count(buyer) AS orphan_rate FROM ({_ORDERS_SQL})")
def _(spark, sf):
    return trust.orphan_ratio(_ORDERS(spark, sf), "buyer", load(spark, sf, "customer").select("c_custkey"))


# ---- profiles ----------------------------------------------------------------------


@query(
    "profile_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, {f'min({c} + 0.0)::DOUBLE' if n else 'NULL::DOUBLE'} AS min_value, {f'max({c} + 0.0)::DOUBLE' if n else 'NULL::DOUBLE'} AS max_value FROM customer"
        for c, n in (("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0))
    ),
)
def _(spark, sf):
    return statistics(load(spark, sf, "customer"))


@query(
    "profile_topk",
    """SELECT 'o_orderpriority' AS column, v AS value, n, rank FROM (SELECT o_orderpriority AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority)::INTEGER AS rank FROM orders GROUP BY 1) WHERE rank <= 3
    UNION ALL SELECT 'o_orderstatus', v, n, rank FROM (SELECT o_orderstatus AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus)::INTEGER AS rank FROM orders GROUP BY 1) WHERE rank <= 3""",
)
def _(spark, sf):
    return top_values(load(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"))


@query(
    "profile_corr",
    """WITH t AS (SELECT l_quantity AS q, l_quantity * 3 AS triple, l_quantity * 3 + l_tax AS nearly FROM lineitem)
    SELECT 'l_quantity' AS a, 'triple' AS b, round(abs(corr(q, triple)), 6) AS correlation, round(avg(q / nullif(triple, 0)), 6) AS ratio FROM t
    UNION ALL SELECT 'l_quantity', 'nearly', round(abs(corr(q, nearly)), 6), round(avg(q / nullif(nearly, 0)), 6) FROM t
    UNION ALL SELECT 'triple', 'nearly', round(abs(corr(triple, nearly)), 6), round(avg(triple / nullif(nearly, 0)), 6) FROM t""",
)
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 3).alias("triple"), (F.col("l_quantity") * 3 + F.col("l_tax")).alias("nearly"))
    return correlations(df).select("a", "b", F.round("correlation", 6).alias("correlation"), F.round("ratio", 6).alias("ratio"))


@query(
    "concept_inference",
    """WITH first AS (SELECT c_name || '@mail.example' AS mail, upper(c_mktsegment[1:3]) AS code FROM customer ORDER BY c_custkey LIMIT 100)
    SELECT "column", concept, avg(hit::INTEGER)::DOUBLE AS share, count(*) AS values FROM (
      SELECT 'mail' AS column, unnest(['email', 'date_iso', 'uuid', 'currency_code']) AS concept, unnest([regexp_matches(mail, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$'), false, false, false]) AS hit FROM first
      UNION ALL SELECT 'code', unnest(['email', 'date_iso', 'uuid', 'currency_code']), unnest([false, false, false, regexp_matches(code, '^[A-Z]{3}$')]) FROM first) GROUP BY 1, 2""",
)
def _(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("@mail.example")).alias("mail"), F.upper(F.substring("c_mktsegment", 1, 3)).alias("code"))
    return concept_matches(df, "c_custkey")


@query(
    "schema_inspect",
    "SELECT 's_suppkey' AS column, 'bigint' AS type, true AS not_null, count(*) = count(DISTINCT s_suppkey) AS unique FROM supplier UNION ALL SELECT 's_nationkey', 'int', count(*) = count(s_nationkey), count(*) = count(DISTINCT s_nationkey) FROM supplier",
)
def _(spark, sf):
    return inspect_schema(load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"))


# ---- chaos -------------------------------------------------------------------------

_MD5 = lambda what, key, seed=42: f"('0x' || substr(md5('{seed}|{what}|' || {key}), 1, 8))::BIGINT"


@query("scn_duplicate", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    return scenarios.run_scenario("duplicate_import", load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("scn_truncate", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT (count(*) * 0.8)::INTEGER FROM orders)")
def _(spark, sf):
    return scenarios.run_scenario("month_end_truncation", load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("scn_delay", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS o_orderdate FROM orders")
def _(spark, sf):
    return scenarios.run_scenario("delayed_reporting", load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", date_column="o_orderdate")


@query(
    "scn_conflict",
    f"""SELECT c_custkey, CASE WHEN {_MD5('conflict|c_acctbal', 'c_custkey')} < {int(0.3 * 2**32)} THEN CASE WHEN {_MD5('conflict|c_acctbal|way', 'c_custkey')} % 2 = 0 THEN c_acctbal * 1.2::DOUBLE ELSE c_acctbal * 0.8::DOUBLE END ELSE c_acctbal END AS c_acctbal,
    CASE WHEN {_MD5('conflict|c_mktsegment', 'c_custkey')} < {int(0.3 * 2**32)} THEN c_mktsegment || '_conflict' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def _(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return scenarios.run_scenario("cross_source_conflict", df, "c_custkey", columns=["c_acctbal", "c_mktsegment"])


@query(
    "scn_aggregate",
    f"""WITH t AS (SELECT c_nationkey AS g, sum((c_custkey * 2)::DOUBLE) AS s FROM customer GROUP BY 1)
    SELECT c_custkey, CASE WHEN {_MD5('mismatch', 'g')} < {int(0.3 * 2**32)} THEN s * ({_MD5('mismatch|by', 'g')} / 4294967296.0::DOUBLE + 0.5::DOUBLE) ELSE s END AS total FROM customer JOIN t ON c_nationkey = g""",
)
def _(spark, sf):
    df = load(spark, sf, "customer").withColumn("amount", F.col("c_custkey") * 2)
    return scenarios.run_scenario("aggregate_mismatch", df, "c_custkey", group="c_nationkey", amount="amount", total="total").select("c_custkey", "total")


@query("scn_schema_evolution", "SELECT o_orderkey, o_custkey AS o_custkey_new, o_orderstatus AS o_orderstatus_v2, o_orderdate AS new_o_orderdate, o_orderpriority AS o_orderpriority_new, NULL::VARCHAR AS new_field FROM orders")
def _(spark, sf):
    return scenarios.run_scenario("schema_evolution", load(spark, sf, "orders"), "o_orderkey", drift=0.8)


_HIT = lambda what, key, p: f"{_MD5(what, key)} < {int(p * 2**32)}"


def _one_of(what: str, key: str, *options: str) -> str:
    return f"[{', '.join(options)}][{_MD5(what, key)} % {len(options)} + 1]"


def _missing_sql(c: str, key: str, p: float, name: str, kind: str = "text") -> str:
    """Column ``c`` (called ``name``) after the missing values of a share ``p``."""
    n = f"{_MD5(f'missing|{name}|kind', key)} % 10"
    gone = f"CASE WHEN {n} < 5 THEN NULL WHEN {n} < 8 THEN '' ELSE '0' END" if kind == "text" else f"CASE WHEN {n} >= 8 THEN 0 END"
    return f"CASE WHEN {_HIT(f'missing|{name}', key, p)} THEN {gone} ELSE {c} END"


# The letters beside each letter of the keyboard: left, right, the row above, the row below.
_KEYS_SQL = """k AS (SELECT * FROM (VALUES (0, 'qwertyuiop'), (1, 'asdfghjkl'), (2, 'zxcvbnm')) t(r, l)),
  letters AS (SELECT r, l, unnest(range(1, length(l) + 1)) AS i FROM k),
  near AS (SELECT substr(a.l, i, 1) AS ch, CASE WHEN i > 1 THEN substr(a.l, i - 1, 1) ELSE '' END || substr(a.l, i + 1, 1)
    || coalesce(substr(up.l, greatest(1, i - 1), i + 2 - greatest(1, i - 1)), '') || coalesce(substr(down.l, greatest(1, i - 1), i + 2 - greatest(1, i - 1)), '') AS beside
    FROM letters a LEFT JOIN k up ON up.r = a.r - 1 LEFT JOIN k down ON down.r = a.r + 1)"""


def _human_sql(table: str, key: str, name: str, p: float) -> str:
    """``table`` with ``name`` after typing noise, as a subquery; ``near`` must be known."""
    c, u = name, f"({_MD5(f'human|{name}|kind', key)} / 4294967296.0::DOUBLE)"
    at = f"(({_MD5(f'human|{name}|at', key)} % greatest(length({c}), 1))::INTEGER + 1)"
    n = _MD5(f"human|{name}|near", key)
    letter = f"CASE WHEN beside IS NOT NULL AND {_HIT(f'human|{name}|beside', key, 0.8)} THEN substr(beside, {n} % length(beside) + 1, 1) ELSE substr('abcdefghijklmnopqrstuvwxyz', {n} % 26 + 1, 1) END"
    typo = f"CASE WHEN length({c}) > 0 THEN substr({c}, 1, {at} - 1) || {letter} || substr({c}, {at} + 1) ELSE {c} END"
    title = f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    case = _one_of(f"human|{name}|case", key, f"upper({c})", f"lower({c})", title)
    space = _one_of(f"human|{name}|space", key, f"'  ' || {c}", f"{c} || '  '", f"replace({c}, ' ', '')")
    short = _one_of(f"human|{name}|short", key, f"substr({c}, 1, 3)", f"substr({c}, 1, 1)")
    noisy = f"CASE WHEN {u} < 0.45 THEN {typo} WHEN {u} < 0.70 THEN {case} WHEN {u} < 0.90 THEN {space} ELSE {short} END"
    return f"(SELECT t.* REPLACE (CASE WHEN {_HIT(f'human|{name}', key, p)} THEN {noisy} ELSE {c} END AS {name}) FROM {table} t LEFT JOIN near ON ch = lower(substr({c}, {at}, 1)))"


def _scientific_sql(c: str) -> str:
    """Three digits of a number of two decimals, none or 1 at least, halves away from zero: by whole hundredths."""
    h = f"round({c} * 100)::BIGINT"
    d = f"(length(({h})::VARCHAR) - 3)"
    m = f"(({h} + (10 ** {d})::BIGINT // 2) // (10 ** {d})::BIGINT)"
    form = lambda m, e: f"({m}) // 100 || '.' || lpad((({m}) % 100)::VARCHAR, 2, '0') || 'e+' || lpad(({e})::INTEGER::VARCHAR, 2, '0')"
    return f"CASE WHEN {c} = 0 THEN '0.00e+00' WHEN {m} = 1000 THEN {form('100', d + ' + 1')} ELSE {form(m, d)} END"


def _sheet_sql(table: str, key: str, p: float, dates=(), numbers=(), texts=()) -> str:
    """``table`` after what a spreadsheet does to its columns, as a subquery."""
    hit = lambda c: _HIT(f"sheet|{c}", key, p)
    form = lambda c: _one_of(f"sheet|{c}|form", key, f"datediff('day', DATE '1899-12-30', {c}::DATE)::VARCHAR", f"strftime({c}, '%-m/%-d/%y')")
    out = [f"CASE WHEN {hit(c)} THEN {form(c)} ELSE strftime({c}, '%Y-%m-%d') END AS {c}" for c in dates]
    out += [f"CASE WHEN {hit(c)} THEN {_scientific_sql(c)} ELSE {c}::VARCHAR END AS {c}" for c in numbers]
    out += [f"CASE WHEN {hit(c)} AND regexp_matches({c}, '^0[0-9]+$') THEN regexp_replace({c}, '^0+(.)', '\\1') ELSE {c} END AS {c}" for c in texts]
    return f"(SELECT * REPLACE ({', '.join(out)}) FROM {table})"


@query("missingness", f"SELECT c_custkey, {_missing_sql('c_mktsegment', 'c_custkey', 0.3, 'c_mktsegment')} AS c_mktsegment FROM customer")
def _(spark, sf):
    return corruptors.missing_values(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.3)


@query("human_noise", f"WITH {_KEYS_SQL} SELECT * FROM {_human_sql(_human_sql('customer', 'c_custkey', 'c_name', 0.3), 'c_custkey', 'c_mktsegment', 0.3)}")
def _(spark, sf):
    return corruptors.human_noise(load(spark, sf, "customer"), "c_custkey", 0.3)


_CODED = "(SELECT *, lpad(o_custkey::VARCHAR, 6, '0') AS code FROM orders)"


@query("spreadsheet_noise", f"SELECT * FROM {_sheet_sql(_CODED, 'o_orderkey', 0.3, ['o_orderdate'], ['o_custkey', 'o_totalprice'], ['o_orderstatus', 'o_orderpriority', 'code'])}")
def _(spark, sf):
    return corruptors.spreadsheet_noise(load(spark, sf, "orders").withColumn("code", F.lpad(F.col("o_custkey").cast("string"), 6, "0")), "o_orderkey", 0.3)


_NOISE = lambda c, changed, plain: f"CASE WHEN NOT {_HIT(f'noise|null|{c}', 'o_orderkey', 0.1)} THEN CASE WHEN {_HIT(f'noise|{c}', 'o_orderkey', 0.2)} THEN {_one_of(f'noise|{c}|form', 'o_orderkey', *changed)} ELSE {plain} END END AS {c}"
_NOISE_SQL = [
    *(_NOISE(c, [f"'RM ' || printf('%.2f', {c}::DOUBLE)", f"printf('%.2f', {c}::DOUBLE) || ' MYR'", f"format('{{:,.2f}}', {c}::DOUBLE)"], f"{c}::VARCHAR") for c in ("o_custkey", "o_totalprice")),
    _NOISE("o_orderdate", [f"strftime(o_orderdate, '{x}')" for x in ("%d/%m/%Y", "%m-%d-%Y", "%Y.%m.%d")], "strftime(o_orderdate, '%Y-%m-%d')"),
    *(_NOISE(c, [f"regexp_replace({c}, '[aeiouAEIOU]', '', 'g')", f"'  ' || {c} || ' '"], c) for c in ("o_orderstatus", "o_orderpriority")),
]


@query("injected_noise", f"SELECT o_orderkey, {', '.join(_NOISE_SQL)} FROM orders")
def _(spark, sf):
    return corruptors.inject_noise(load(spark, sf, "orders"), "o_orderkey", 0.2)


@query(
    "value_synonyms",
    f"""SELECT * REPLACE (CASE WHEN NOT {_HIT('value|c_mktsegment', 'c_custkey', 0.5)} THEN c_mktsegment WHEN c_mktsegment = 'BUILDING' THEN {_one_of('value|c_mktsegment', 'c_custkey', "'bldg'", "'construction'")}
    WHEN c_mktsegment = 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS c_mktsegment) FROM customer""",
)
def _(spark, sf):
    return corruptors.value_synonyms(load(spark, sf, "customer"), "c_custkey", 0.5, synonyms={"building": ["bldg", "construction"], "machinery": ["machines"]})


@query("header_noise", "SELECT o_orderkey, o_orderdate AS transaction_date, o_totalprice AS rate FROM orders")
def _(spark, sf):
    return corruptors.corrupt_headers(load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 1.0, key="o_orderkey").table


@query("name_drift", "SELECT l_orderkey, l_partkey AS \"Item_Code\", l_quantity AS qty_rcvd FROM lineitem")
def _(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("order_quantity"))
    return corruptors.drift_names(df, 1.0).table


_LOGGED = [f"SELECT c_custkey, '{c}' AS column, {c}::VARCHAR AS a, ({_missing_sql(c, 'c_custkey', 0.1, c, kind)})::VARCHAR AS b FROM customer" for c, kind in (("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text"))]


@query("corruption_log", f"SELECT c_custkey::VARCHAR AS row, \"column\", 'MISSING' AS corruption_type, a AS original_value, b AS new_value FROM ({' UNION ALL '.join(_LOGGED)}) WHERE a IS DISTINCT FROM b")
def _(spark, sf):
    df = load(spark, sf, "customer")
    return corruptors.change_log(df, corruptors.missing_values(df, "c_custkey", 0.1), "c_custkey", "MISSING")


_SEVERE = _sheet_sql(_human_sql(_human_sql("orders", "o_orderkey", "o_orderstatus", 0.5), "o_orderkey", "o_orderpriority", 0.5), "o_orderkey", 0.5, ["o_orderdate"], ["o_custkey", "o_totalprice"])
_RENAMED = {"o_custkey": "o_cstky", "o_orderstatus": "oOrderstatus", "o_totalprice": "rate", "o_orderdate": "o_orderdate", "o_orderpriority": "oOrderpriority"}


@query("corrupt_severe", f"WITH {_KEYS_SQL} SELECT o_orderkey, {', '.join(f'{_missing_sql(c, 'o_orderkey', 0.5, c)} AS {n}' for c, n in _RENAMED.items())} FROM {_SEVERE}")
def _(spark, sf):
    return corruptors.corrupt(load(spark, sf, "orders"), "o_orderkey", "Severe").table


_BROKEN = f"SELECT CASE WHEN {_HIT('negative|o_totalprice', 'o_orderkey', 0.2)} THEN o_totalprice * -1.5 - 10 END AS v FROM orders"


@query("chaos_detection", f"SELECT count(v) AS corrupted, count(v) FILTER (v < 0) AS detected, (count(v) FILTER (v < 0))::DOUBLE / count(v) AS rate FROM ({_BROKEN})")
def _(spark, sf):
    model = {"fields": {}, "odcs_contracts": {"row_level_rules": [{"assertion": "non_negative", "column": "o_totalprice"}]}}
    df = load(spark, sf, "orders")
    broken = arena.break_contracts(df, model, "o_orderkey", 0.2)
    log = corruptors.change_log(df, broken, "o_orderkey", "NEGATIVE")
    return arena.detection(log, Violations(broken, [Rule.of(r) for r in model["odcs_contracts"]["row_level_rules"]]).flagged(), "o_orderkey")


@query("broken_dependencies", f"SELECT o_orderkey, CASE WHEN {_HIT('break|0', 'o_orderkey', 0.3)} THEN o_totalprice + 999.99::DOUBLE ELSE o_totalprice END AS o_totalprice, strftime(CASE WHEN {_HIT('break|1', 'o_orderkey', 0.3)} THEN day + 13 ELSE day END, '%Y-%m-%d') AS seen FROM (SELECT *, o_orderdate::DATE AS day FROM orders)")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    df = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", day.alias("day"), day.alias("seen"))
    rules = [{"assertion": "expression", "formula": "o_totalprice > 0"}, {"assertion": "date_tolerance", "column": "seen", "target_column": "day", "tolerance_window_days": 3}]
    return corruptors.break_dependencies(df, "o_orderkey", rules, 0.3).select("o_orderkey", "o_totalprice", F.col("seen").cast("string").alias("seen"))


@query(
    "generated_rows",
    f"""SELECT o_orderkey, 'product_id-' || o_orderkey AS product_id, {_MD5('order_quantity', 'o_orderkey')} % 9999 + 1 AS order_quantity, round({_MD5('unit_net_price', 'o_orderkey')} / 4294967296.0::DOUBLE * 10000.0::DOUBLE, 2) AS unit_net_price,
    strftime(DATE '2020-01-01' + ({_MD5('arrival_date', 'o_orderkey')} % 2192)::INTEGER, '%Y-%m-%d') AS arrival_date FROM orders""",
)
def _(spark, sf):
    """A made-up row for every order."""
    fields = {"product_id": {"type": "string"}, "order_quantity": {"type": "int"}, "unit_net_price": {"type": "float"}, "arrival_date": {"type": "date"}}
    return arena.generate(spark, {"fields": fields, "odcs_contracts": {"row_level_rules": []}}, load(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


# ---- review ------------------------------------------------------------------------

_REVIEW_MODEL = {"odcs_contracts": {"row_level_rules": [{"assertion": "non_negative", "column": "c_acctbal"}, {"assertion": "enum_match", "column": "c_mktsegment", "allowed_values": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}]}}
_REVIEW_BAD = "(c_acctbal < 0 OR c_mktsegment = 'AUTOMOBILE')"


@query(
    "review_decisions",
    f"""SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_custkey % 4 AS a, c_mktsegment, CASE WHEN c_custkey % 4 = 2 THEN 0.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer WHERE {_REVIEW_BAD})
    WHERE a = 1 OR (a = 2 AND c_mktsegment <> 'AUTOMOBILE')""",
)
def _(spark, sf):
    bad = trust.evaluate(load(spark, sf, "customer"), _REVIEW_MODEL["odcs_contracts"]).quarantine
    k = F.col("c_custkey") % 4
    action = F.when(k == 0, "DROP").when(k == 1, "OVERRIDE").when(k == 2, "PATCH")
    decisions = bad.select("c_custkey", action.alias("action"), F.create_map(F.lit("c_acctbal"), F.lit("0.5")).alias("patches")).where("action IS NOT NULL")
    rescued, _, _ = review(bad, decisions, _REVIEW_MODEL, "c_custkey")
    return rescued.select("c_custkey", "c_acctbal")


@query("error_matrix", "SELECT c_custkey, 'c_acctbal' AS column, 'non_negative' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum_match' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def _(spark, sf):
    return error_matrix(trust.evaluate(load(spark, sf, "customer"), _REVIEW_MODEL["odcs_contracts"]).quarantine, "c_custkey")


@query(
    "failure_context",
    f"SELECT count(*) AS n_rows, count(*) AS n_values, false AS all_lower, true AS all_upper, false AS edge_space, false AS all_digits, avg(length(c_mktsegment)) AS mean_length FROM customer WHERE {_REVIEW_BAD}",
)
def _(spark, sf):
    return failure_statistics(trust.evaluate(load(spark, sf, "customer"), _REVIEW_MODEL["odcs_contracts"]).quarantine, "c_mktsegment")


# ---- flagship ------------------------------------------------------------------------

_FLAGSHIP_MODEL = {
    "fields": {f: {"type": t} for f, t in (("l_orderkey", "int"), ("l_discount", "float"), ("o_orderstatus", "string"), ("c_acctbal", "float"), ("segment", "string"), ("net", "float"), ("ship", "date"), ("band", "string"))},
    "odcs_contracts": {
        "row_level_rules": [
            {"assertion": "not_null", "column": "l_orderkey"},
            {"assertion": "range", "column": "l_discount", "min": 0.0, "max": 0.1},
            {"assertion": "enum_match", "column": "o_orderstatus", "allowed_values": ["F", "O", "P"]},
            {"assertion": "non_negative", "column": "c_acctbal"},
        ],
        "dataset_level_rules": [{"metric": "volume_check", "min_rows": 1}],
    },
}


@query(
    "flagship",
    """SELECT l_orderkey, l_discount, o_orderstatus, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD' ELSE c_mktsegment END AS segment, l_extendedprice * (1 - l_discount) AS net,
    strftime(l_shipdate, '%Y-%m-%d') AS ship, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS band
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 AND l_discount BETWEEN 0 AND 0.1 AND o_orderstatus IN ('F', 'O', 'P')""",
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their order and customer, cleaned and checked; the clean rows."""
    steps = {
        "with_order": node("JOIN", tab("source"), tab("orders"), how="inner", left_on="l_orderkey", right_on="o_orderkey", null_keys=False),
        "lines": node("JOIN", step("with_order"), tab("customer"), how="inner", left_on="o_custkey", right_on="c_custkey", null_keys=False),
        "price": node("COPY", step("lines"), column="l_extendedprice"),
        "discount": node("COPY", step("lines"), column="l_discount"),
        "rest": node("SUBTRACT", val(1), step("discount")),
        "shipped": node("COPY", step("lines"), column="l_shipdate"),
        "raw_segment": node("COPY", step("lines"), column="c_mktsegment"),
        "quantity": node("COPY", step("lines"), column="l_quantity"),
    }
    outputs = {
        **pick("lines", "l_orderkey", "l_discount", "o_orderstatus", "c_acctbal"),
        "segment": node("FUZZY_MAP", step("raw_segment"), mapping_dict={"BUILDING": "BLD"}),
        "net": node("MULTIPLY", step("price"), step("rest"), to="float"),
        "ship": node("PARSE_DATE", step("shipped")),
        "band": node("CASE_WHEN", step("quantity"), cases=[{"condition": "_temp < 10", "value": "small"}, {"condition": "_temp < 30", "value": "middle"}], default="large"),
    }
    tables = {n: load(spark, sf, n) for n in ("orders", "customer")}
    target = run(load(spark, sf, "lineitem"), outputs, steps, tables, fields=_FLAGSHIP_MODEL["fields"])
    return trust.evaluate(target, _FLAGSHIP_MODEL["odcs_contracts"]).clean


from . import relation_queries  # noqa: E402, F401  more queries under the same two tables
