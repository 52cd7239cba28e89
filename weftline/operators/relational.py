"""Table operators: filters, joins, set operations, groups and reshaping.

``args`` are values of the compiler (``Relation`` or ``Series``); results are new
relations made with ``ctx.derive`` (rows keep their row ids), ``ctx.extend`` or
``ctx.fresh`` (rows have new ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import hidden
from . import sketches
from ..functions.coerce import java_pattern, strip
from ..functions.expressions import parse

HOWS = {"left": "left", "right": "right", "outer": "full", "inner": "inner", "cross": "cross", "left_semi": "left_semi", "left_anti": "left_anti"}


def _listed(v) -> list[str]:
    return [v] if isinstance(v, str) else list(v or ())


def column_map(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"`{c}`") for c in df.columns}


def filter_rows(args, opts, ctx):
    """The rows where ``condition`` is true; ``null_mode`` as in the expression language."""
    rel = ctx.relation(args[0])
    return ctx.derive(rel, rel.df.where(parse(opts["condition"], column_map(rel.df), opts.get("null_mode", "sql"))))


def check_join(opts) -> list[str]:
    how = opts.get("how", "left")
    if how not in HOWS:
        return [f"unknown how {how!r}"]
    if how != "cross" and not opts.get("on") and not (opts.get("left_on") and opts.get("right_on")):
        return ["JOIN needs on, or left_on and right_on"]
    if len(_listed(opts.get("left_on"))) != len(_listed(opts.get("right_on"))):
        return ["left_on and right_on differ in length"]
    return []


def join(args, opts, ctx):
    """Equi-join of the first two inputs; nulls match nulls; equal names get ``_x`` and ``_y``.

    ``null_keys: false`` makes null keys match nothing, which lets Spark spread
    them. How rows meet (broadcast, sort, hash) is left to Spark's sizes.
    """
    left, right = (ctx.plain(ctx.relation(a)) for a in args[:2])
    how, on = opts.get("how", "left"), _listed(opts.get("on"))
    lk, rk = (on, on) if on else (_listed(opts.get("left_on")), _listed(opts.get("right_on")))
    if how == "cross":
        lk = rk = []
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if how in ("left_semi", "left_anti"):
        shared = set()
    a = left.select(*(F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(left.columns)))
    b = right.select(*(F.col(f"`{c}`").alias(f"r_{i}") for i, c in enumerate(right.columns)))
    at = lambda df, p, c: F.col(f"{p}_{df.columns.index(c)}")
    same = (lambda x, y: x == y) if opts.get("null_keys") is False else (lambda x, y: x.eqNullSafe(y))
    conds = [same(at(left, "l", x), at(right, "r", y)) for x, y in zip(lk, rk, strict=True)]
    joined = a.crossJoin(b) if not conds else a.join(b, reduce(lambda x, y: x & y, conds), HOWS[how])
    out = []
    for c in left.columns:
        value = at(left, "l", c)
        if c in on and how in ("right", "outer"):
            value = F.coalesce(value, at(right, "r", c))
        out.append(value.alias(f"{c}_x" if c in shared else c))
    if how not in ("left_semi", "left_anti"):
        out += [at(right, "r", c).alias(f"{c}_y" if c in shared else c) for c in right.columns if c not in on]
    return ctx.fresh(joined.select(*out))


def union(args, opts, ctx):
    """All inputs by column name, missing ones null; ``distinct`` (default) drops repeated rows."""
    frames = [ctx.plain(ctx.relation(a)) for a in args]
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return ctx.fresh(out.distinct() if opts.get("distinct", True) else out)


def _aggregate(df: DataFrame, c: str, how: str, rid: str | None, null_sum: bool = False) -> Column:
    v = F.col(f"`{c}`")
    simple = {
        "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "prod": F.product,
    }
    if how == "sum":
        kind = df.schema[c].dataType
        if null_sum:
            return F.sum(v)
        return F.coalesce(F.sum(v), F.lit(0).cast("double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "long"))
    if how == "size":
        return F.count("*")
    if how in sketches.AGGREGATES:
        return sketches.aggregate(v, df.schema[c].dataType, how)
    if how in ("first", "last"):
        order = F.when(v.isNotNull(), F.col(rid)) if rid else F.when(v.isNotNull(), F.monotonically_increasing_id())
        return (F.min_by if how == "first" else F.max_by)(v, order)
    if how not in simple:
        raise ValueError(f"unknown aggregate {how!r}")
    return simple[how](v)


def check_group_by(opts) -> list[str]:
    sets, by = opts.get("sets"), _listed(opts.get("by"))
    if sets is None:
        return ["grouping_id, null_keys need sets"] if opts.get("grouping_id") else []
    if isinstance(sets, str):
        return [] if sets in ("cube", "rollup") else ["sets is cube, rollup or a list of lists of keys"]
    if not isinstance(sets, list) or not all(isinstance(x, list) for x in sets) or not sets:
        return ["sets is cube, rollup or a list of lists of keys"]
    return [f"sets: {c!r} is not in by" for x in sets for c in x if c not in by]


def _grouping_sets(df: DataFrame, by: list[str], opts) -> DataFrame:
    """Rows ready to be grouped by several sets of keys at once (one Expand, one shuffle)."""
    keys, sets = [F.col(f"`{k}`") for k in by], opts["sets"]
    if isinstance(sets, str):
        return df.cube(*keys) if sets == "cube" else df.rollup(*keys)
    return df.groupingSets([[F.col(f"`{c}`") for c in x] for x in sets], *keys)


def group_by(args, opts, ctx):
    """``agg``: column to function, or to a list (named ``column_function``). Rows with a null key are left out.

    ``sets`` (cube, rollup, or lists of keys) gives a row for the groups of each set, other keys null.
    ``null_keys: true`` then keeps null keys, and ``grouping_id`` names a column that tells them from the
    nulls of subtotals: one bit a key, first key highest, 1 where the key is summed over. An empty table has no groups, nor a grand total.
    The sum of nothing but nulls is zero, or null with ``null_sum: true``, as in SQL.
    """
    rel, by = ctx.relation(args[0]), _listed(opts["by"])
    agg = opts["agg"] if isinstance(opts["agg"], dict) else None
    if agg is None:
        agg = {c: opts["agg"] for c in ctx.plain(rel).columns if c not in by}
    rid = None
    if any(h in ("first", "last") for v in agg.values() for h in _listed(v)):
        rid = ctx.row_ids(rel)
    df = rel.df
    out = [
        _aggregate(df, c, how, rid, bool(opts.get("null_sum"))).alias(c if isinstance(v, str) else f"{c}_{how}")
        for c, v in agg.items() for how in _listed(v)
    ]
    kept = reduce(lambda x, y: x & y, (F.col(f"`{k}`").isNotNull() for k in by))
    if opts.get("sets"):
        if opts.get("grouping_id"):
            out.append(F.grouping_id().alias(opts["grouping_id"]))
        return ctx.fresh(_grouping_sets(df if opts.get("null_keys") else df.where(kept), by, opts).agg(*out))
    return ctx.fresh(df.where(kept).groupBy(*(F.col(f"`{k}`") for k in by)).agg(*out))


def explode(args, opts, ctx):
    """One row for each part of ``column`` split at ``delimiter``; a longer delimiter is a pattern. Null words become null."""
    rel, c, by = ctx.relation(args[0]), opts["column"], opts.get("delimiter", ",")
    parts = F.split(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), rf"\Q{by}\E" if len(by) == 1 else java_pattern(by), -1)
    part = strip(F.col(hidden("part")))
    null = part.isin("", "nan", "None")
    out = rel.df.withColumn(hidden("part"), F.explode(parts)).withColumn(c, F.when(~null, part)).drop(hidden("part"))
    return ctx.derive(rel, out)


def pivot(args, opts, ctx):
    """``values`` summed (or ``aggfunc``) by ``index``, a column for each value of ``columns``.

    Give ``pivot_values`` to spare the pass that finds them. A cell without rows
    is null; one whose values are all null is zero under sum.
    """
    df, index, c, v = ctx.plain(ctx.relation(args[0])), _listed(opts["index"]), opts["columns"], opts["values"]
    how = opts.get("aggfunc", "sum")
    kept = reduce(lambda x, y: x & y, (F.col(f"`{k}`").isNotNull() for k in [*index, c]))
    value = _aggregate(df, v, how, None)
    if how == "sum":
        value = F.when(F.count(F.lit(1)) > 0, value)
    grouped = df.where(kept).withColumn(hidden("column"), F.col(f"`{c}`").cast("string")).groupBy(*(F.col(f"`{k}`") for k in index))
    names = [str(x) for x in opts["pivot_values"]] if opts.get("pivot_values") else None
    return ctx.fresh(grouped.pivot(hidden("column"), names).agg(value))


def unpivot(args, opts, ctx):
    """``value_vars`` (default: all others) to rows of name and value; numbers meet as double, others as text."""
    df, ids = ctx.plain(ctx.relation(args[0])), _listed(opts["id_vars"])
    values = _listed(opts.get("value_vars")) or [c for c in df.columns if c not in ids]
    kinds = {df.schema[c].dataType for c in values}
    to = None if len(kinds) == 1 else "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
    if to:
        df = df.select(*(F.col(f"`{c}`").cast(to).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns))
    return ctx.fresh(df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], opts.get("var_name", "variable"), opts.get("value_name", "value")))
