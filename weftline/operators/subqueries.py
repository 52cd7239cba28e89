"""Subqueries of plans as joins: EXISTS, IN and NOT IN with SQL's nulls, and scalar subqueries.

The second input is the subquery; ``on`` (or ``left_on``, ``right_on``) are the columns in which it is
correlated with the first, null equal to nothing, as in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import parse
from ..graph import hidden
from .meeting import Sides, key_pairs, theta_join


def check_correlation(opts) -> list[str]:
    lk, rk = key_pairs(opts)
    return [] if len(lk) == len(rk) else ["left_on and right_on differ in length"]


def _correlated(s: Sides, opts) -> Column | None:
    conds = [s.l(a) == s.r(b) for a, b in zip(*key_pairs(opts), strict=True)]
    if opts.get("condition"):
        conds.append(parse(opts["condition"], s.names(), opts.get("null_mode", "sql")))
    return reduce(lambda x, y: x & y, conds) if conds else None


def where_exists(args, opts, ctx):
    """Rows for which the subquery has a row (``negate``: has none); ``condition`` may compare columns of both (shared names with _x, _y)."""
    how = "left_anti" if opts.get("negate") else "left_semi"
    if not key_pairs(opts)[0] and opts.get("condition"):
        return theta_join(args, {"condition": opts["condition"], "how": how}, ctx)
    s = Sides(*(ctx.plain(ctx.relation(a)) for a in args[:2]))
    cond = _correlated(s, opts)
    if cond is None:  # one row tells it all
        return ctx.fresh(s.named(s.a.join(F.broadcast(s.b.limit(1)), F.lit(True), how), how))
    return ctx.fresh(s.named(s.a.join(s.b, cond, how), how))


def where_in(args, opts, ctx):
    """Rows whose ``column`` is among the subquery's ``sub_column`` (``negate``: is not).

    NOT IN is true of an empty subquery, and otherwise only if the value is not null, no value of the subquery
    is null, and none is equal. Groups are summed up for that, so it stays two joins.
    """
    s = Sides(*(ctx.plain(ctx.relation(a)) for a in args[:2]))
    value, other = s.l(opts["column"]), s.r(opts.get("sub_column") or opts["column"])
    conds = _correlated(s, {**opts, "condition": None})
    same = value == other if conds is None else conds & (value == other)
    if not opts.get("negate"):
        return ctx.fresh(s.named(s.a.join(s.b, same, "left_semi"), "left_semi"))
    lk, rk = key_pairs(opts)
    sums = [F.count("*").alias("n_rows"), F.count(other).alias("n_known")]
    if lk:
        keys = [f"k_{i}" for i in range(len(lk))]
        groups = s.b.groupBy(*(s.r(c).alias(k) for c, k in zip(rk, keys, strict=True))).agg(*sums)
        left = s.a.join(groups, reduce(lambda x, y: x & y, (s.l(c) == F.col(k) for c, k in zip(lk, keys, strict=True))), "left")
    else:
        left = s.a.join(F.broadcast(s.b.agg(*sums)), F.lit(True))  # one row
    fine = F.col("n_rows").isNull() | (F.col("n_rows") == 0) | (value.isNotNull() & (F.col("n_rows") == F.col("n_known")))
    return ctx.fresh(s.named(left.where(fine).join(s.b, same, "left_anti"), "left_anti"))


def scalar_subquery(args, opts, ctx):
    """A column of the first input: ``agg`` (a GROUP_BY function) of the subquery's ``column`` over its rows with equal keys. Counts of nothing are 0, other values null."""
    from .relational import _aggregate

    rel, right = ctx.relation(args[0]), ctx.plain(ctx.relation(args[1]))
    lk, rk = key_pairs(opts)
    out, keys = ctx.fresh_name(), [hidden(f"k_{i}") for i in range(len(lk))]
    how = opts["agg"]
    value = _aggregate(right, opts["column"], how, None)
    if how == "sum":  # SQL's sum of nothing
        value = F.when(F.count(F.col(f"`{opts['column']}`")) > 0, value)
    value = value.alias(out)
    if lk:
        groups: DataFrame = right.groupBy(*(F.col(f"`{c}`").alias(k) for c, k in zip(rk, keys, strict=True))).agg(value)
        rel.df = rel.df.join(groups, reduce(lambda x, y: x & y, (F.col(f"`{c}`") == F.col(k) for c, k in zip(lk, keys, strict=True))), "left").drop(*keys)
    else:
        rel.df = rel.df.join(F.broadcast(right.agg(value)), F.lit(True))  # one row
    return ctx.extend(rel, F.coalesce(out, F.lit(0)) if how in ("count", "size", "nunique", "approx_nunique") else F.col(out))
