"""INTERSECT and EXCEPT as bag arithmetic: equal rows are counted by side, in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _counted(frames: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Distinct rows (c_0, c_1, ...) with the number of times each table holds them (n_0, n_1, ...).

    Columns meet by name, a missing one as null; nulls are equal to nulls. Counts are
    summed up before the shuffle, so a row that fills a third of the table is one row a task.
    """
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [f.limit(0) for f in frames])
    if maps := [f.name for f in together.schema.fields if isinstance(f.dataType, (T.MapType, T.VariantType))]:
        raise ValueError(f"columns {maps} cannot be compared")
    names = together.columns
    kinds = {f.name: f.dataType for f in together.schema.fields}

    def side(i: int, df: DataFrame) -> DataFrame:
        held = set(df.columns)
        cells = (F.col(f"`{c}`").cast(kinds[c]) if c in held else F.lit(None).cast(kinds[c]) for c in names)
        return df.select(*(v.alias(f"c_{k}") for k, v in enumerate(cells)), *(F.lit(int(i == j)).cast("long").alias(f"n_{j}") for j in range(len(frames))))

    rows = reduce(lambda x, y: x.union(y), [side(i, f) for i, f in enumerate(frames)])
    cells = [f"c_{k}" for k in range(len(names))]
    return rows.groupBy(*cells).agg(*(F.sum(f"n_{j}").alias(f"n_{j}") for j in range(len(frames)))), names


def _repeated(counted: DataFrame, names: list[str], times, all_rows: bool) -> DataFrame:
    rows = counted.withColumn("times", times).where("times > 0")
    if all_rows:  # a row is written in runs of at most 1,000, so a row that occurs often enough fills no task's memory
        rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0), ((F.col("times") - 1) / 1000).cast("long"))))
        rows = rows.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("times") - F.col("run") * 1000).cast("int"))))
    return rows.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(names)))


def intersect(args, opts, ctx):
    """Rows that all inputs hold; ``all``: as often as the input that has them least often."""
    counted, names = _counted([ctx.plain(ctx.relation(a)) for a in args])
    least = F.least(*(F.col(f"n_{j}") for j in range(len(args))))
    return ctx.fresh(_repeated(counted, names, least, bool(opts.get("all"))))


def except_(args, opts, ctx):
    """Rows of the first input that no other holds; ``all``: each occurrence elsewhere takes one away."""
    counted, names = _counted([ctx.plain(ctx.relation(a)) for a in args])
    others = reduce(lambda x, y: x + y, (F.col(f"n_{j}") for j in range(1, len(args))))
    times = F.col("n_0") - others if opts.get("all") else F.when(others == 0, F.col("n_0"))
    return ctx.fresh(_repeated(counted, names, times, bool(opts.get("all"))))
