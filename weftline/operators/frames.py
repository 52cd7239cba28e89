"""Offsets, tiles and frames: lag, lead, ntile, and aggregates over row or range frames.

With ``partition_by`` they are Spark's windows. Over a whole table no task may hold all
rows: rows are dealt out along the order, each part is numbered from its predecessors'
counts, and a part is lent the rows beyond its borders that its frames reach. Range frames depend
on the order value alone, so equal values are summed up first and a value that fills a third of the
table is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..graph import hidden, keep
from .meeting import measure

OFFSETS = ("lag", "lead")
AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}
FRAMED = (*OFFSETS, "ntile", "count")


def check_frame(opts) -> list[str]:
    how, frame, out = opts.get("function"), opts.get("frame"), []
    if how in (*OFFSETS, "ntile") and not opts.get("order_by"):
        out.append(f"{how} needs order_by")
    if how in OFFSETS and (not isinstance(opts.get("offset", 1), int) or opts.get("offset", 1) < 1):
        out.append("offset is a whole number of at least 1")
    if how == "ntile" and (not isinstance(opts.get("buckets"), int) or opts["buckets"] < 1):
        out.append("ntile needs buckets, a whole number of at least 1")
    if frame is None:
        return out
    if how not in AGGREGATES:
        return [*out, f"{how} takes no frame"]
    if not isinstance(frame, dict) or frame.get("kind") not in ("rows", "range") or set(frame) - {"kind", "start", "end"}:
        return [*out, "frame has kind (rows or range), start and end"]
    start, end = frame.get("start"), frame.get("end")
    bounds = [b for b in (start, end) if b is not None]
    if not all(isinstance(b, (int, float)) and not isinstance(b, bool) for b in bounds) or len(bounds) == 2 and start > end:
        out.append("start and end are numbers, start first; null is unbounded")
    if not opts.get("order_by"):
        out.append("a frame needs order_by")
    order = opts.get("order_by")
    if frame["kind"] == "range" and not isinstance(order, str) and len(order or ()) != 1:
        out.append("a range frame has one order column")
    if not opts.get("partition_by") and len(bounds) < 2:
        out.append("an unbounded frame needs partition_by; cumulative_sum runs over whole tables")
    return out


def _bounds(frame: dict) -> tuple:
    at = lambda b, default: default if b is None else b
    return at(frame.get("start"), Window.unboundedPreceding), at(frame.get("end"), Window.unboundedFollowing)


def in_range(agg: str, by: list[str], at: str, start, end) -> Column:
    """An aggregate over a range frame along the column ``at``; bounds may be fractions."""
    bound = lambda b, way: f"UNBOUNDED {way}" if b is None else "CURRENT ROW" if b == 0 else f"{abs(b)!r}{'D' if isinstance(b, float) else 'L'} {'PRECEDING' if b < 0 else 'FOLLOWING'}"
    key = f"CAST(`{at}` AS DOUBLE)" if isinstance(start, float) or isinstance(end, float) else f"`{at}`"
    parts = f"PARTITION BY {', '.join(f'`{c}`' for c in by)} " if by else ""
    return F.expr(f"{agg} OVER ({parts}ORDER BY {key} RANGE BETWEEN {bound(start, 'PRECEDING')} AND {bound(end, 'FOLLOWING')})")


def partitioned(how: str, target: str, by: list[str], order: list[Column], rid: Column, opts, at: str | None) -> Column:
    """The functions inside partitions. ``at``: the column that a range frame's offsets count along."""
    part, value = Window.partitionBy(*(F.col(f"`{c}`") for c in by)), F.col(f"`{target}`")
    if how in OFFSETS:
        return (F.lag if how == "lag" else F.lead)(value, opts.get("offset", 1), opts.get("default")).over(part.orderBy(*order, rid))
    if how == "ntile":
        return F.ntile(opts["buckets"]).over(part.orderBy(*order, rid))
    frame = opts.get("frame")
    if not frame:
        return AGGREGATES[how](value).over(part)
    if frame["kind"] == "rows":
        return AGGREGATES[how](value).over(part.orderBy(*order, rid).rowsBetween(*_bounds(frame)))
    return in_range(f"{how}(`{target}`)", by, at, frame.get("start"), frame.get("end"))


def numbered(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt out along ``order`` (without ties) with ``part`` and ``pos`` from 0; and (part, first, last, total) of the parts that have rows."""
    part, pos = hidden("part"), hidden("pos")
    rows = keep(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))  # one row a part
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(F.col(part).alias("part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), F.col("n"), F.sum("n").over(Window.partitionBy()).alias("total"))
    parts = keep(parts.select("part", "first", (F.col("first") + F.col("n") - 1).alias("last"), "total"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    out = rows.withColumn(pos, inside).join(F.broadcast(parts.select(F.col("part").alias(hidden("own")), F.col("first").alias(hidden("first")), F.col("total").alias(hidden("total")))), F.col(part) == F.col(hidden("own")))
    return out.withColumn(pos, F.col(pos) + F.col(hidden("first"))).drop(hidden("own"), hidden("first")), parts


def lent(rows: DataFrame, parts: DataFrame, at: Column, low: Column, high: Column) -> DataFrame:
    """``rows`` and, marked as ``lent``, those of other parts whose ``at`` lies between a part's ``low`` and ``high``.

    ``parts`` has a row for each part, so it is broadcast.
    """
    part = hidden("part")
    reach = parts.select(F.col("part").alias(hidden("to")), low.alias(hidden("low")), high.alias(hidden("high")))
    others = rows.join(F.broadcast(reach), (F.col(hidden("to")) != F.col(part)) & (at >= F.col(hidden("low"))) & (at <= F.col(hidden("high"))))
    others = others.withColumn(part, F.col(hidden("to"))).drop(hidden("to"), hidden("low"), hidden("high")).withColumn(hidden("lent"), F.lit(True))
    return rows.withColumn(hidden("lent"), F.lit(False)).unionByName(others)


def over_rows(df: DataFrame, how: str, target: Column, order: list[Column], out: str, opts) -> DataFrame:
    """lag, lead, ntile and row frames over all of ``df``, as column ``out``."""
    rows, parts = numbered(df, order)
    pos, total = F.col(hidden("pos")), F.col(hidden("total"))
    drop = [hidden(n) for n in ("part", "pos", "total", "lent")]
    if how == "ntile":
        n = opts["buckets"]
        size, larger = F.floor(total / n), F.pmod(total, F.lit(n))
        inner = larger * (size + 1)
        tile = F.when(pos < inner, F.floor(pos / (size + 1)) + 1).otherwise(larger + F.floor((pos - inner) / F.greatest(size, F.lit(1))) + 1)
        return rows.withColumn(out, tile.cast("int")).drop(*drop)
    if how in OFFSETS:
        k = opts.get("offset", 1)
        start = end = -k if how == "lag" else k
    else:
        start, end = opts["frame"]["start"], opts["frame"]["end"]
    both = lent(rows, parts, pos, F.col("first") + min(start, 0), F.col("last") + max(end, 0))
    w = Window.partitionBy(hidden("part")).orderBy(hidden("pos")).rowsBetween(start, end)
    if how in OFFSETS:
        value = F.first(target).over(w)
        if opts.get("default") is not None:
            value = F.when((pos + start >= 0) & (pos + start < total), value).otherwise(F.lit(opts["default"]))
    else:
        value = AGGREGATES[how](target).over(w)
    return both.withColumn(out, value).where(~F.col(hidden("lent"))).drop(*drop)


def over_range(df: DataFrame, how: str, target: Column, value: Column, out: str, frame: dict) -> DataFrame:
    """A range frame over all of ``df``: equal values are summed up, summed values framed, and the frames joined back."""
    at = hidden("at")
    cells = {"s": F.sum(target), "n": F.count(target), "lo": F.min(target), "hi": F.max(target)}
    wanted = {"sum": ["s", "n"], "mean": ["s", "n"], "count": ["n"], "min": ["lo"], "max": ["hi"]}[how]
    values = df.groupBy(value.alias(at)).agg(*(cells[c].alias(c) for c in wanted))
    some = values.where(F.col(at).isNotNull())
    rows = keep(some.repartitionByRange(at).withColumn(hidden("part"), F.spark_partition_id()))
    parts = rows.groupBy(F.col(hidden("part")).alias("part")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    start, end = frame["start"], frame["end"]
    both = lent(rows, parts, F.col(at), F.col("first") + min(start, 0), F.col("last") + max(end, 0))
    over = lambda agg: in_range(agg, [hidden("part")], at, start, end)
    found = {"sum": lambda: F.when(over("sum(n)") > 0, over("sum(s)")), "mean": lambda: over("sum(s)") / F.nullif(over("sum(n)"), F.lit(0)), "count": lambda: F.coalesce(over("sum(n)"), F.lit(0)), "min": lambda: over("min(lo)"), "max": lambda: over("max(hi)")}[how]()
    framed = both.withColumn(out, found).where(~F.col(hidden("lent"))).select(at, out)
    nulls = values.where(F.col(at).isNull()).select(at, {"sum": lambda: F.col("s"), "mean": lambda: F.col("s") / F.nullif("n", F.lit(0)), "count": lambda: F.col("n"), "min": lambda: F.col("lo"), "max": lambda: F.col("hi")}[how]().alias(out))
    table = framed.unionByName(nulls)
    own = hidden("own")
    return df.withColumn(own, value).join(table, F.col(own).eqNullSafe(F.col(at)), "left").drop(own, at)


def order_value(df: DataFrame, name: str, ascending: bool) -> tuple[Column, int]:
    """What a range frame counts along (rising along the order), and how many of it are one unit of an offset: seconds of timestamps, days of dates."""
    kind = df.schema[name].dataType
    value = measure(F.col(f"`{name}`"), kind)
    return value if ascending else -value, 1_000_000 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else 1
