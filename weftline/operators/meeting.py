"""Joins beyond equality: intervals, nearest in time, and any condition.

None of them falls back to a Cartesian product. Intervals meet in bins, times meet along a
sorted range whose last values are carried over its borders, and other conditions are
tested on a grid sized from the counted sides. Columns that both tables have get ``_x`` and
``_y``, as in JOIN.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, inf, isfinite, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expressions import ExpressionError, identifiers, parse
from ..graph import keep

#: Rows of one key on one side that a task may meet; keys with more are dealt to a grid of tasks.
KEY_ROWS = 100_000
#: A side of at most so many rows is broadcast, after it has been counted.
BROADCAST_ROWS = 10_000
#: Pairs of rows that a task may compare; more are dealt to more tasks.
TASK_PAIRS = 50_000_000
#: Quantiles of interval lengths that become bin widths.
QUANTILES = (0.5, 0.9, 0.99, 1.0)
HOWS = ("inner", "left", "left_semi", "left_anti")
DIRECTIONS = ("backward", "forward", "nearest")


def listed(v) -> list[str]:
    return [v] if isinstance(v, str) else list(v or ())


class Sides:
    """Two tables under names that cannot clash: l_0, l_1, ... and r_0, r_1, ..."""

    def __init__(self, left: DataFrame, right: DataFrame):
        self.left, self.right = left, right
        self.shared = set(left.columns) & set(right.columns)
        self.a = left.select(*(F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(left.columns)))
        self.b = right.select(*(F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(right.columns)))

    def l(self, name: str) -> Column:  # noqa: E743
        return F.col(f"l_{self.left.columns.index(name)}")

    def r(self, name: str) -> Column:
        return F.col(f"r_{self.right.columns.index(name)}")

    def named(self, df: DataFrame, how: str = "inner") -> DataFrame:
        if how in ("left_semi", "left_anti"):
            return df.select(*(self.l(c).alias(c) for c in self.left.columns))
        x = [self.l(c).alias(f"{c}_x" if c in self.shared else c) for c in self.left.columns]
        return df.select(*x, *(self.r(c).alias(f"{c}_y" if c in self.shared else c) for c in self.right.columns))

    def names(self) -> dict[str, Column]:
        """Columns by the names that a condition uses."""
        out = {f"{c}_x" if c in self.shared else c: self.l(c) for c in self.left.columns}
        return out | {f"{c}_y" if c in self.shared else c: self.r(c) for c in self.right.columns}

    def finish(self, meet, how: str, having) -> DataFrame:
        """``meet(a, b)`` gives the matching pairs, ``having(a, b)`` the ``l_id`` of left rows that have one, without making the pairs."""
        if how == "inner":
            return self.named(meet(self.a, self.b))
        a = keep(self.a.withColumn("l_id", F.monotonically_increasing_id()))
        found = having(a, self.b).select("l_id").distinct()
        if how == "left":
            alone = a.join(found, "l_id", "left_anti")
            return self.named(meet(a, self.b).unionByName(alone, allowMissingColumns=True))
        return self.named(a.join(found, "l_id", how), how)


def key_pairs(opts) -> tuple[list[str], list[str]]:
    on = listed(opts.get("on"))
    return (on, on) if on else (listed(opts.get("left_on")), listed(opts.get("right_on")))


def check_keys(opts, hows=HOWS) -> list[str]:
    out = [f"unknown how {opts.get('how')!r}"] if opts.get("how", "inner") not in hows else []
    if len(listed(opts.get("left_on"))) != len(listed(opts.get("right_on"))):
        out.append("left_on and right_on differ in length")
    return out


def measure(c: Column, kind: T.DataType) -> Column:
    """A number along which values can be dealt out and compared: days, microseconds, or the value."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampNTZType):  # as it stands on the clock, whatever the session's zone
        minutes = (F.unix_date(F.to_date(c)) * 24 + F.hour(c)) * 60 + F.minute(c)
        return minutes.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.NumericType):
        return c
    raise ValueError(f"{kind.simpleString()} has no order to measure; numbers, dates and timestamps have")


def spread(a: DataFrame, b: DataFrame, keys: list[str], most: int = KEY_ROWS, task_pairs: int = TASK_PAIRS, hot_keys: int = 2_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two more keys, so that no task gets more than about ``most`` rows of one key.

    Rows of a key that has more are dealt to rows (left) and columns (right) of a grid. Such keys
    are counted first: there are at most all rows over ``most``, and ``most`` grows with the
    tables so that these are at most ``hot_keys``. Where more than ``task_pairs`` pairs of rows meet, both sides are
    dealt to as many tasks as these fill: by their bytes alone a few tasks would get all of them.
    """
    counted = a.groupBy(*keys).agg(F.count("*").alias("na")).join(b.groupBy(*keys).agg(F.count("*").alias("nb")), keys)
    counted = keep(counted)
    total, pairs = (x or 0 for x in counted.agg(F.sum(F.col("na") + F.col("nb")), F.sum(F.col("na").cast("double") * F.col("nb"))).first())
    most = max(most, total // hot_keys)
    tasks = ceil(pairs / task_pairs)
    hot = counted.where(F.greatest("na", "nb") > most).select(*keys, F.ceil(F.col("na") / most).cast("int").alias("rows"), F.ceil(F.col("nb") / most).cast("int").alias("cols"))
    if hot.isEmpty():
        return *dealt(a, b, keys, tasks), keys
    deal = lambda df, n: F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.coalesce(F.col(n), F.lit(1))).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = a.join(F.broadcast(hot), keys, "left").withColumn("g_row", deal(a, "rows")).withColumn("g_col", across("cols")).drop("rows", "cols")
    b = b.join(F.broadcast(hot), keys, "left").withColumn("g_col", deal(b, "cols")).withColumn("g_row", across("rows")).drop("rows", "cols")
    keys = [*keys, "g_row", "g_col"]
    return *dealt(a, b, keys, tasks), keys


def dealt(a: DataFrame, b: DataFrame, keys: list[str], tasks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by their keys in at least ``tasks`` tasks, as adaptive execution merges tasks of few bytes; one task is left to Spark."""
    if tasks <= 1:
        return a, b
    n = max(tasks, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return a.repartition(n, *keys), b.repartition(n, *keys)


# ---- intervals ---------------------------------------------------------------------


def check_range_join(opts) -> list[str]:
    out = check_keys(opts)
    for side in ("left", "right"):
        if not opts.get(f"{side}_start"):
            out.append(f"RANGE_JOIN needs {side}_start (and {side}_end unless it is a point)")
    if opts.get("closed", "both") not in ("both", "left"):
        out.append("closed is both or left")
    return out


def bin_widths(lengths: DataFrame) -> list[float]:
    """Rising bin widths from the quantiles of the column ``length``; the last is no shorter than any interval."""
    found = lengths.where("length > 0").agg(F.percentile_approx("length", [*QUANTILES], 1_000).alias("q"), F.max("length").alias("m")).first()
    if not found or not found.m:
        return [1.0]
    return sorted({float(v) for v in found.q} | {float(found.m)})


def in_bins(df: DataFrame, start: str, end: str, widths: list[float]) -> DataFrame:
    """``df`` with ``level`` (the least width that holds the interval) and a row for each ``at`` and ``bin`` of this and wider levels.

    An interval touches at most two bins of a level (three if rounding intervenes), so rows are bounded by the number of widths.
    """
    length = F.col(end) - F.col(start)
    level = reduce(lambda out, i: F.when(length <= widths[i], i).otherwise(out), reversed(range(len(widths) - 1)), F.lit(len(widths) - 1))
    where = lambda c, w: F.floor(F.col(c) / w) if isfinite(w) else F.lit(0).cast("long")
    place = lambda i: lambda b: F.struct(F.lit(i).alias("at"), b.alias("bin"))
    bins = [F.when(F.col("level") <= i, F.transform(F.sequence(where(start, w), where(end, w)), place(i))) for i, w in enumerate(widths)]
    out = df.withColumn("level", level).withColumn("place", F.explode(F.flatten(F.filter(F.array(*bins), lambda x: x.isNotNull()))))
    return out.select("*", "place.at", "place.bin").drop("place")


def range_join(args, opts, ctx):
    """Pairs whose intervals overlap; an end that is left out makes its side a point.

    Both sides are cut into bins of a few widths taken from the lengths' quantiles. A pair meets
    at the wider one's level, in the one bin that holds the later start, so it is found once.
    ``on`` (or ``left_on``, ``right_on``) adds keys that must be equal. Ends belong to the interval unless
    ``closed`` is "left". Null keys and bounds, and intervals that end before they begin,
    meet nothing.
    """
    s = Sides(*(ctx.plain(ctx.relation(a)) for a in args[:2]))
    lk, rk = key_pairs(opts)
    names = (opts["left_start"], opts.get("left_end") or opts["left_start"], opts["right_start"], opts.get("right_end") or opts["right_start"])
    kinds = [s.left.schema[n].dataType for n in names[:2]] + [s.right.schema[n].dataType for n in names[2:]]
    ls, le = (measure(s.l(n), k) for n, k in zip(names[:2], kinds[:2], strict=True))
    rs, re = (measure(s.r(n), k) for n, k in zip(names[2:], kinds[2:], strict=True))
    half = opts.get("closed", "both") == "left"
    point = {"l": names[0] == names[1], "r": names[2] == names[3]}
    keys = [f"k_{i}" for i in range(len(lk))]

    def prepared(df: DataFrame, side: str, start: Column, end: Column, key: list[Column]) -> DataFrame:
        out = df.withColumns({f"{side}s": start, f"{side}e": end, **dict(zip(keys, key, strict=True))})
        fine = F.col(f"{side}s") < F.col(f"{side}e") if half and not point[side] else F.col(f"{side}s") <= F.col(f"{side}e")
        return reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, out.where(fine & ~F.isnan(F.col(f"{side}s").cast("double")) & ~F.isnan(F.col(f"{side}e").cast("double"))))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = prepared(a, "l", ls, le, [s.l(c) for c in lk]), prepared(b, "r", rs, re, [s.r(c) for c in rk])
        length = lambda df, x: df.select((F.col(f"{x}e") - F.col(f"{x}s")).cast("double").alias("length"))
        widths = bin_widths(length(a, "l").unionByName(length(b, "r")))
        a = in_bins(a, "ls", "le", widths).withColumnRenamed("level", "l_level")
        b = in_bins(b, "rs", "re", widths).withColumnRenamed("level", "r_level")
        a, b, by = spread(a, b, [*keys, "at", "bin"])
        before = lambda p, q, side: F.col(p) < F.col(q) if half and not point[side] else F.col(p) <= F.col(q)
        overlap = before("ls", "re", "r") & before("rs", "le", "l")
        later = F.greatest("ls", "rs").cast("double")
        owner = reduce(lambda out, i: F.when(F.col("at") == i, F.floor(later / widths[i]) if isfinite(widths[i]) else F.lit(0).cast("long")).otherwise(out), range(len(widths)), F.lit(None).cast("long"))
        return a.join(b, by).where((F.col("at") == F.greatest("l_level", "r_level")) & (F.col("bin") == owner) & overlap)

    def having(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = prepared(a, "l", ls, le, [s.l(c) for c in lk]), prepared(b, "r", rs, re, [s.r(c) for c in rk])
        begins_at_end = not half or point["l"]  # whether an interval that begins where the left one ends meets it
        reach = furthest_before(a.select("l_id", "ls", F.col("le").alias("t"), *keys), b.select(F.col("rs").alias("t"), F.col("re").alias("reach"), *keys), keys, begins_at_end)
        return reach.where(F.col("ls") < F.col("reach") if half and not point["r"] else F.col("ls") <= F.col("reach"))

    return ctx.fresh(s.finish(meet, opts.get("how", "inner"), having))


def furthest_before(a: DataFrame, b: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    """``a`` (with ``t`` and keys) with the greatest ``reach`` of the rows of ``b`` at or (unless ``exact``) before t.

    A left interval meets one of the right exactly if one that begins by its end reaches its start,
    so no pair is made. Both sides are dealt out along (keys, t) as for the nearest in time; equal times of
    either side are told apart by a hash.
    """
    side = lambda is_left: F.lit(int(is_left == exact))
    both = a.withColumns({"side": side(True), "mine": F.lit(True), "reach": F.lit(None).cast(b.schema["reach"].dataType)})
    both = both.unionByName(b.withColumns({"side": side(False), "mine": F.lit(False)}), allowMissingColumns=True)
    both = both.withColumn("salt", F.xxhash64("mine", F.monotonically_increasing_id()))
    order = ["t", "side", "salt"]
    parts = keep(both.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = parts.withColumn("upto", F.max("reach").over(inside))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("part", *keys).agg(F.max("reach").alias("reach")).select("part", *keys, F.max("reach").over(before).alias("carried")).where("carried IS NOT NULL")
    out = held.where("mine").drop("reach").join(ends, ["part", *keys], "left")
    return out.withColumn("reach", F.greatest("upto", "carried"))


# ---- nearest in time ---------------------------------------------------------------


def check_asof_join(opts) -> list[str]:
    out = check_keys(opts, ("inner", "left"))
    if not opts.get("left_at") or not opts.get("right_at"):
        out.append("ASOF_JOIN needs left_at and right_at")
    if opts.get("direction", "backward") not in DIRECTIONS:
        out.append(f"unknown direction {opts.get('direction')!r}")
    t = opts.get("tolerance")
    if t is not None and (not isinstance(t, (int, float)) or isinstance(t, bool) or t < 0 or not t < inf):
        out.append("tolerance is a number of at least 0")
    return out


def last_before(a: DataFrame, b: DataFrame, keys: list[str], forward: bool, exact: bool) -> DataFrame:
    """``a`` (with ``t`` and keys) with ``found``: the ``row`` of ``b`` that is last at or before t.

    Both sides are dealt out together along (keys, t), so a key that holds all rows
    fills all tasks. A task carries values along by itself; what it begins with comes
    from the tasks before it, one row a key and task.
    """
    first = (not exact) if not forward else exact  # whether the left side comes first at equal times, as the order is read
    side = lambda is_left: F.lit(int(is_left != first))
    both = a.withColumns({"side": side(True), "row": F.lit(None).cast(b.schema["row"].dataType), "mine": F.lit(True)})
    both = both.unionByName(b.withColumns({"side": side(False), "mine": F.lit(False)}), allowMissingColumns=True)
    # equal times of the left side are told apart by a hash, so that many of them fill several tasks
    both = both.withColumn("salt", F.when(F.col("mine"), F.xxhash64("left", F.monotonically_increasing_id())).otherwise(F.lit(0)))
    order = ["t", "side", "salt"]
    parts = keep(both.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    along = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    inside = Window.partitionBy("part", *keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    held = parts.withColumn("found", F.last("row", ignorenulls=True).over(inside))
    point = F.when(F.col("row").isNotNull(), F.struct(*order))
    ends = parts.groupBy("part", *keys).agg((F.min_by if forward else F.max_by)("row", point).alias("end"))
    before = Window.partitionBy(*keys).orderBy(F.col("part").desc() if forward else F.col("part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("part", *keys, F.last("end", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL")
    out = held.where("mine").join(ends, ["part", *keys], "left")
    return out.select("left", "t", F.coalesce("found", "carried").alias("found"))


def asof_join(args, opts, ctx):
    """Each left row with the right row nearest in time among those of equal keys.

    ``direction``: the last one at or before (backward), the first at or after (forward), or the
    nearer of both (nearest; backward if equally near). ``tolerance`` bounds the distance, in seconds for
    timestamps, days for dates. ``exact: false`` leaves out equal times. Of right rows with equal keys
    and time the greatest by ``tie_by`` and then by all columns counts. Null keys and times
    match nothing; ``how``: left (default) keeps such rows, inner drops them.
    """
    s = Sides(*(ctx.plain(ctx.relation(a)) for a in args[:2]))
    lk, rk = key_pairs(opts)
    keys = [f"k_{i}" for i in range(len(lk))]
    lt, rt = opts["left_at"], opts["right_at"]
    kinds = s.left.schema[lt].dataType, s.right.schema[rt].dataType
    if not all(isinstance(k, T.NumericType) for k in kinds) and kinds[0] != kinds[1]:
        raise ValueError(f"{lt} and {rt} are measured differently; cast one of them")
    unit = 1_000_000 if isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) else 1
    a = s.a.select(F.struct(*s.a.columns).alias("left"), measure(s.l(lt), kinds[0]).alias("t"), *(s.l(c).alias(k) for c, k in zip(lk, keys, strict=True)))
    b = s.b.select(F.struct(*s.b.columns).alias("row"), F.struct(*(s.r(c) for c in [*listed(opts.get("tie_by")), *s.right.columns])).alias("rank"), measure(s.r(rt), kinds[1]).alias("t"), *(s.r(c).alias(k) for c, k in zip(rk, keys, strict=True)))
    whole = lambda df: reduce(lambda d, c: d.where(F.col(c).isNotNull()), ["t", *keys], df)
    b = whole(b).groupBy("t", *keys).agg(F.max_by("row", "rank").alias("row")).withColumn("row", F.struct("t", "row"))
    direction, exact, how = opts.get("direction", "backward"), opts.get("exact", True), opts.get("how", "left")
    if direction == "nearest":
        first = last_before(whole(a), b, keys, False, exact).withColumn("earlier", F.col("found")).select(F.struct("left", "earlier").alias("left"), "t", *(F.col(f"left.{s.a.columns[s.left.columns.index(c)]}").alias(k) for c, k in zip(lk, keys, strict=True)))
        both = last_before(first, b, keys, True, exact).select("left.left", "left.earlier", "t", F.col("found").alias("later"))
        near = F.col("earlier").isNotNull() & (F.col("later").isNull() | (F.col("t") == F.col("earlier.t")) | (F.col("t") - F.col("earlier.t") <= F.col("later.t") - F.col("t")))
        out = both.select("left", "t", F.when(near, F.col("earlier")).otherwise(F.col("later")).alias("found"))
    else:
        out = last_before(whole(a), b, keys, direction == "forward", exact)
    if opts.get("tolerance") is not None:
        near = (F.col("found.t") == F.col("t")) | (F.abs(F.col("found.t") - F.col("t")) <= opts["tolerance"] * unit)  # equal infinities too
        out = out.withColumn("found", F.when(near, F.col("found")))
    out = out.select("left", F.col("found.row").alias("row"))
    if how == "inner":
        out = out.where("row IS NOT NULL")
    else:
        broken = reduce(lambda x, y: x | y, (F.col(c).isNull() for c in ["t", *keys]))
        out = out.unionByName(a.where(broken).select("left"), allowMissingColumns=True)
    return ctx.fresh(s.named(out.select("left.*", "row.*")))


# ---- any condition -----------------------------------------------------------------


def check_theta_join(opts) -> list[str]:
    out = [f"unknown how {opts.get('how')!r}"] if opts.get("how", "inner") not in HOWS else []
    try:
        identifiers(str(opts.get("condition", "")))
    except ExpressionError as e:
        out.append(str(e))
    return out


def grid(n_left: int, n_right: int, cells: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``cells`` cells whose cells get as few rows as can be: n_left / rows = n_right / columns."""
    rows = min(max(1, round(sqrt(cells * n_left / max(n_right, 1)))), cells)
    return rows, max(1, ceil(cells / rows))


def theta_join(args, opts, ctx):
    """Pairs for which ``condition`` (over both tables' columns, shared names with _x and _y) is true.

    Both sides are counted. A side of few rows is broadcast. Otherwise left rows are dealt to the rows
    of a grid and right rows to its columns; each cell sees its share of both sides, at most ``TASK_PAIRS`` pairs,
    whatever the values are, so no value can make it large. Left rows that must only have a partner, or none, look for the first
    one in each cell and make no pairs. A condition that holds an equality is better a JOIN.
    """
    s = Sides(*(ctx.plain(ctx.relation(a)) for a in args[:2]))
    condition = parse(opts["condition"], s.names(), opts.get("null_mode", "sql"))
    n = s.left.count(), s.right.count()
    tasks = max(int(ctx.spark.conf.get("spark.sql.shuffle.partitions")), ceil(n[0] * n[1] / TASK_PAIRS))

    def meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        few = min(n) <= int(opts.get("broadcast_rows", BROADCAST_ROWS))
        if few and n[0] * n[1] > TASK_PAIRS:  # a small file is read by one task
            a, b = (a, b.repartition(tasks)) if n[0] < n[1] else (a.repartition(tasks), b)
        if few and how == "inner":
            return F.broadcast(a).join(b, condition) if n[0] < n[1] else a.join(F.broadcast(b), condition)
        if few and n[0] >= n[1]:
            return a.join(F.broadcast(b), condition, how)
        rows, cols = grid(*n, tasks)
        deal = lambda df, k: F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(k))
        a = a.withColumn("g", deal(a, rows)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.col("g") * cols + c))).drop("g")
        b = b.withColumn("g", deal(b, cols)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * cols + F.col("g")))).drop("g")
        a, b = (df.repartition(rows * cols, "cell") for df in (a, b))  # a given number, which adaptive execution does not lower
        out = a.join(b, (a["cell"] == b["cell"]) & condition, how)
        return out.drop(a["cell"]).drop(b["cell"]) if how == "inner" else out.drop("cell")

    return ctx.fresh(s.finish(meet, opts.get("how", "inner"), lambda a, b: meet(a, b, "left_semi")))
