"""Business scenarios over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import hidden, running
from .chance import choose, happens, uniform
from .corruptors import _chance, _pick


def duplicate_import(df: DataFrame, key: str, **_) -> DataFrame:
    """Every row twice."""
    return df.unionAll(df)


def month_end_truncation(df: DataFrame, key: str, keep_ratio: float = 0.8, **_) -> DataFrame:
    """The first rows by key only: at least one, ``keep_ratio`` of all. Rows are numbered in parallel; a limit this large is one task."""
    n = df.count()
    tied = df.withColumn(hidden("t"), F.monotonically_increasing_id())
    return running(tied, [F.col(f"`{key}`"), F.col(hidden("t"))], {hidden("n"): F.lit(1)}).where(F.col(hidden("n")) <= max(1, int(n * keep_ratio))).drop(hidden("t"), hidden("n"))


def schema_evolution(df: DataFrame, key: str, drift: float = 0.5, seed: int = 42, **_) -> DataFrame:
    """Columns renamed, at most a fifth dropped, and an empty new one."""
    others = [c for c in df.columns if c != key]
    dropped = sorted(others, key=lambda c: _chance(seed, f"drop|{c}"))[: int(len(others) * 0.2)]
    new = lambda c: _pick(seed, f"evolve|{c}", [f"{c}_new", f"{c}_v2", f"new_{c}"]) if c != key and _chance(seed, f"evolves|{c}") < drift else c
    kept = df.select(*(F.col(f"`{c}`").alias(new(c)) for c in df.columns if c not in dropped))
    return kept.withColumn("new_field", F.lit(None).cast("string"))


def cross_source_conflict(df: DataFrame, key: str, columns: list[str], probability: float = 0.3, seed: int = 42, **_) -> DataFrame:
    """Another source disagrees: numbers a fifth up or down, texts marked."""
    k, out = F.col(key), {}
    for name in columns:
        c = F.col(f"`{name}`")
        number = isinstance(df.schema[name].dataType, T.NumericType)
        other = choose(seed, f"conflict|{name}|way", k, [c * 1.2, c * 0.8]) if number else F.concat(c.cast("string"), F.lit("_conflict"))
        out[name] = F.when(happens(seed, f"conflict|{name}", k, probability), other).otherwise(c.cast("double") if number else c)
    return df.withColumns(out)


def delayed_reporting(df: DataFrame, key: str, date_column: str, days: int = 7, **_) -> DataFrame:
    """All dates later by ``days``."""
    return df.withColumn(date_column, F.date_format(F.date_add(F.to_date(F.col(f"`{date_column}`")), days), "yyyy-MM-dd"))


def aggregate_mismatch(df: DataFrame, key: str, group: str, amount: str, total: str, probability: float = 0.3, seed: int = 42, **_) -> DataFrame:
    """Stated group totals that are off in some groups. Totals are summed before they meet the rows."""
    sums = df.groupBy(F.col(f"`{group}`").alias(hidden("g"))).agg(F.sum(F.col(f"`{amount}`").cast("double")).alias(hidden("t")))
    g = F.col(hidden("g"))
    off = F.when(happens(seed, "mismatch", g, probability), F.col(hidden("t")) * (uniform(seed, "mismatch|by", g) + 0.5)).otherwise(F.col(hidden("t")))
    return df.join(sums.withColumn(hidden("t"), off), F.col(f"`{group}`") == g, "left").withColumn(total, F.col(hidden("t"))).drop(hidden("g"), hidden("t"))


SCENARIOS: dict[str, Callable[..., DataFrame]] = {
    "duplicate_import": duplicate_import,
    "month_end_truncation": month_end_truncation,
    "schema_evolution": schema_evolution,
    "cross_source_conflict": cross_source_conflict,
    "delayed_reporting": delayed_reporting,
    "aggregate_mismatch": aggregate_mismatch,
}


def run_scenario(name: str, df: DataFrame, key: str, **options) -> DataFrame:
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}; known: {', '.join(SCENARIOS)}")
    return SCENARIOS[name](df, key, **options)
