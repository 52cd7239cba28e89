"""Profiles of messy tables from a few aggregations."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed patterns of business concepts, tried in this order.
CONCEPTS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "currency_code": r"^[A-Z]{3}$",
}
#: Cells that a task counts exactly.
TASK_CELLS = 500_000
CONCEPT_SHARE, CONCEPT_VALUES, CORRELATION, ENUM_VALUES = 0.9, 100, 0.95, 50


def hash_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows, always the same ones: those whose hash is lowest."""
    n = df.count()
    if n <= rows:
        return df
    h = F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`").cast("string") for c in df.columns)), F.lit(1_000_000))
    return df.where(h < int(1_000_000 * rows / n))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, rows, nulls, distinct_values, min_value, max_value (numbers as double) of every column.

    Exact distinct counts write every row once a column, dealt to tasks of ``TASK_CELLS`` cells before anything is
    counted, so that no task holds more of them; sketches (``exact=False``, 2 % at one sigma) need one pass.
    """
    num = set(_numeric(df))
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        aggs.append(F.count(v).alias(f"c{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(v, 0.02).alias(f"d{i}"))
        aggs += [f(v.cast("double") if c in num else F.lit(None).cast("double")).alias(f"{k}{i}") for k, f in (("l", F.min), ("h", F.max))]
    plain = df.agg(*aggs)
    if exact and df.columns:
        plain = plain.crossJoin(_distinct_counts(df))
    rows = F.array(*(
        F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value"))
        for i, c in enumerate(df.columns)
    ))
    return plain.select(F.explode(rows).alias("r")).select("r.*")


def _distinct_counts(df: DataFrame) -> DataFrame:
    """d0, d1, ...: how many distinct values each column has, in one row."""
    names = [f"v{i}" for i in range(len(df.columns))]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * len(names) // TASK_CELLS))
    null = lambda c: F.lit(None).cast(df.schema[c].dataType)
    cell = lambda i: F.struct(F.lit(i).alias("at"), *((F.col(f"`{c}`") if j == i else null(c)).alias(names[j]) for j, c in enumerate(df.columns)))
    cells = df.select(F.explode(F.array(*map(cell, range(len(names))))).alias("cell")).select("cell.*")
    some = reduce(lambda x, y: x | y, (F.col(n).isNotNull() for n in names))
    each = cells.where(some).repartition(tasks, "at", *names).groupBy("at", *names).agg(F.lit(1).alias("one"))
    return each.agg(*(F.count(F.when(F.col("at") == i, 1)).alias(f"d{i}") for i in range(len(names))))


def top_values(df: DataFrame, k: int = 3) -> DataFrame:
    """column, value, n, rank: each column's most frequent values, ties by value; all columns in one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))).alias("x")
    counted = df.select(cells).where("x.value IS NOT NULL").groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def correlations(df: DataFrame, least: float = CORRELATION) -> DataFrame:
    """a, b, correlation, ratio of numeric column pairs with an absolute correlation above ``least``."""
    pairs = list(combinations(_numeric(df), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double, ratio double")
    v = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.abs(F.corr(v(a), v(b))).alias(f"c{i}"), F.avg(F.try_divide(v(a), v(b))).alias(f"r{i}")]
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation"), F.col(f"r{i}").alias("ratio")) for i, (a, b) in enumerate(pairs)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").where((F.col("correlation") > least) & F.col("ratio").isNotNull())


def concept_matches(df: DataFrame, order: str | None = None) -> DataFrame:
    """column, concept, share, values: how many of the first 100 values fit each concept's pattern."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parts = None
    for c in texts:
        col = F.col(f"`{c}`")
        first = df.where(col.isNotNull())
        first = (first.orderBy(F.col(f"`{order}`")) if order else first).select(col.alias("v")).limit(CONCEPT_VALUES)
        one = first.agg(F.count("*").alias("values"), *(F.avg(F.col("v").rlike(p).cast("double")).alias(k) for k, p in CONCEPTS.items()))
        rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("concept"), F.col(k).alias("share"), F.col("values").alias("values")) for k in CONCEPTS))
        one = one.select(F.explode(rows).alias("r")).select("r.*")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return df.sparkSession.createDataFrame([], "column string, concept string, share double, values long")
    return parts


def profile(df: DataFrame, max_sample_rows: int | None = 10_000, order: str | None = None) -> dict[str, Any]:
    """A dictionary of what each column holds; larger tables are profiled on a fixed sample, or whole and with sketched distinct counts if ``max_sample_rows`` is None."""
    whole = max_sample_rows is None
    df = df if whole else hash_sample(df, max_sample_rows)
    stats = {r["column"]: r for r in statistics(df, exact=not whole).collect()}
    tops: dict[str, list] = {}
    for r in top_values(df).orderBy("column", "rank").collect():
        tops.setdefault(r["column"], []).append(r["value"])
    concepts: dict[str, str] = {}
    for r in concept_matches(df, order).collect():
        if r["share"] is not None and r["share"] >= CONCEPT_SHARE:
            concepts.setdefault(r["column"], r["concept"])
    num = set(_numeric(df))
    fields = {}
    for c in df.columns:
        s = stats[c]
        meta = {"native_type": df.schema[c].dataType.simpleString(), "null_ratio": round(s["nulls"] / max(1, s["rows"]), 4), "fingerprint": {}}
        meta["logical_type"] = "numeric" if c in num else "string_or_categorical"
        if s["rows"] > s["nulls"]:
            meta["fingerprint"]["top_samples"] = tops.get(c, [])
            if c in num:
                meta["fingerprint"] |= {"min": s["min_value"], "max": s["max_value"]}
            elif s["distinct_values"] < ENUM_VALUES:
                meta["fingerprint"]["unique_count"] = s["distinct_values"]
        if c in concepts:
            meta["inferred_semantic_type"] = concepts[c]
        fields[c] = meta
    best: dict[str, tuple] = {}
    for r in correlations(df).collect():
        for a, b, ratio in ((r["a"], r["b"], r["ratio"]), (r["b"], r["a"], 1 / r["ratio"] if r["ratio"] else None)):
            if ratio is not None and r["correlation"] > best.get(a, (0,))[0]:
                best[a] = (r["correlation"], b, ratio)
    for c, (conf, other, ratio) in best.items():
        fields[c]["relationships"] = [{"with": other, "type": "linear", "formula": f"x * {ratio:.4f}", "confidence": round(conf, 4)}]
    return {"total_rows": int(next(iter(stats.values()))["rows"]) if stats else 0, "fields": fields}


def matches_concept(value: str) -> str | None:
    return next((k for k, p in CONCEPTS.items() if re.search(p, value)), None)
