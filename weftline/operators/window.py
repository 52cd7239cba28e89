"""Windows, fills, order and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.coerce import lit
from ..graph import hidden, running
from . import frames
from .relational import _listed

FUNCTIONS = ("row_number", "rank", "dense_rank", "sum", "mean", "max", "min", "cumulative_sum", *frames.FRAMED)


def check_window(opts) -> list[str]:
    if opts.get("function") not in FUNCTIONS:
        return [f"unknown window function {opts.get('function')!r}"]
    return frames.check_frame(opts)


def check_fill(opts) -> list[str]:
    if opts.get("method") in ("ffill", "bfill"):
        return []
    return ["unknown fill method"] if opts.get("method") else [] if opts.get("value") is not None else ["FILLNA needs method or value"]


def directions(by: list[str], ascending, default: bool = True) -> list[bool]:
    if isinstance(ascending, (list, tuple)):
        return [*map(bool, ascending), *[default] * (len(by) - len(ascending))]
    return [default if ascending is None else bool(ascending)] * len(by)


def sorted_by(by: list[str], ascending) -> list:
    return [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in zip(by, directions(by, ascending), strict=True)]


def fill(args, opts, ctx):
    """Nulls by ``value``, or by the value before or after in row order.

    Fills by neighbours go over all rows in order; ``partition_by`` lets them run
    in parallel. Without it, blocks of rows are filled by themselves and the last
    value of earlier blocks is carried in (see ``ctx.carry``).
    """
    series = args[0]
    method = opts.get("method")
    if method is None:
        return ctx.column(series, lambda c: F.coalesce(c, lit(opts["value"])))
    by = _listed(opts.get("partition_by"))
    if not by:
        return ctx.carry(series, forward=method == "ffill")
    rid = ctx.row_ids(series.relation)
    w = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy(F.col(rid))
    if method == "ffill":
        return ctx.column(series, lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ctx.column(series, lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def window_apply(args, opts, ctx):
    """A window function of a table as a column of it, in its rows' own order.

    ``row_number`` orders by ``order_by`` (ties by row); ranks are those of
    ``target_column``; ``sum mean max min`` are over the whole partition;
    ``cumulative_sum`` runs in order, null where the value is null. ``ascending``
    covers partition keys first if it is a list. ``lag`` and ``lead`` take ``offset`` and ``default``, ``ntile``
    takes ``buckets``; ``sum mean max min count`` take a ``frame`` (kind rows or range, start, end) along ``order_by``.
    """
    rel, how = ctx.relation(args[0]), opts["function"]
    by, order = _listed(opts.get("partition_by")), _listed(opts.get("order_by"))
    up = opts.get("ascending", True)
    if isinstance(up, (list, tuple)):
        up = list(up)[len(by) :] if len(up) > len(order) else up
    target = F.col(f"`{opts['target_column']}`")
    if how in frames.FRAMED or opts.get("frame"):
        return _framed(rel, how, target, by, order, up, opts, ctx)
    if not by:
        return _over_all(rel, how, opts["target_column"], order, up, ctx)
    part = Window.partitionBy(*(F.col(f"`{c}`") for c in by))
    held = None
    for c in by:
        held = F.col(f"`{c}`").isNotNull() if held is None else held & F.col(f"`{c}`").isNotNull()
    if how in ("rank", "dense_rank"):
        first = directions([opts["target_column"]], up)[0]
        value = (F.rank if how == "rank" else F.dense_rank)().over(part.orderBy(target.asc_nulls_last() if first else target.desc_nulls_last()))
        value = F.when(target.isNotNull(), value).cast("double")
    elif how in ("row_number", "cumulative_sum"):
        w = part.orderBy(*sorted_by(order, up), F.col(ctx.row_ids(rel)))
        value = F.row_number().over(w) if how == "row_number" else F.when(target.isNotNull(), F.sum(target).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        value = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how](target).over(part)
        if how == "sum":
            value = F.coalesce(value, F.lit(0))
    return ctx.extend(rel, F.when(held, value) if held is not None else value)


def _framed(rel, how, target, by, order, up, opts, ctx):
    """Offsets, tiles and frames; null where a partition key is null."""
    rid, keys, frame, at = F.col(ctx.row_ids(rel)), sorted_by(order, up), opts.get("frame") or {}, None
    if frame.get("kind") == "range":
        value, unit = frames.order_value(rel.df, order[0], directions(order, up)[0])
        frame = {k: v * unit if k in ("start", "end") and v is not None else v for k, v in frame.items()}
        at = ctx.extend(rel, value).name
    if by:
        out = frames.partitioned(how, opts["target_column"], by, keys, rid, {**opts, "frame": frame}, at)
        held = reduce(lambda x, y: x & y, (F.col(f"`{c}`").isNotNull() for c in by))
        return ctx.extend(rel, F.when(held, out))
    name = ctx.fresh_name()
    if how == "count" and not frame:
        rel.df = rel.df.crossJoin(F.broadcast(rel.df.agg(F.count(target).alias(name))))
    elif at:
        rel.df = frames.over_range(rel.df, how, target, F.col(at), name, frame)
    else:
        rel.df = frames.over_rows(rel.df, how, target, [*keys, rid], name, opts)
    return ctx.extend(rel, F.col(name))


def _over_all(rel, how, name, order, up, ctx):
    """The functions over a whole table, without a task that holds all its rows.

    Totals are one aggregated row; running values add up ranges of the order; ranks
    are found over the distinct values and joined back, so equal values meet nowhere.
    """
    target = F.col(f"`{name}`")
    out = ctx.fresh_name()
    if how in ("sum", "mean", "max", "min"):
        total = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how](target)
        rel.df = rel.df.crossJoin(F.broadcast(rel.df.agg((F.coalesce(total, F.lit(0)) if how == "sum" else total).alias(out))))
        return ctx.extend(rel, F.col(out))
    if how in ("row_number", "cumulative_sum"):
        rid = ctx.row_ids(rel)
        rel.df = running(rel.df, [*sorted_by(order, up), F.col(rid)], {out: F.lit(1) if how == "row_number" else target})
        return ctx.extend(rel, F.col(out) if how == "row_number" else F.when(target.isNotNull(), F.col(out)))
    values = rel.df.where(target.isNotNull()).groupBy(target.alias(hidden("v"))).agg(F.count("*").alias(hidden("n")))
    first = directions([name], up)[0]
    summed = running(values, [F.col(hidden("v")).asc() if first else F.col(hidden("v")).desc()], {out: F.col(hidden("n")) if how == "rank" else F.lit(1)})
    value = F.col(out) - F.col(hidden("n")) + 1 if how == "rank" else F.col(out)
    rel.df = rel.df.join(summed.select(hidden("v"), value.cast("double").alias(out)), target == F.col(hidden("v")), "left").drop(hidden("v"))
    return ctx.extend(rel, F.col(out))


def order_by(args, opts, ctx):
    """Rows by ``by``, nulls last. With ``reset_index`` (default) rows get new ids in this order."""
    rel, by = ctx.relation(args[0]), _listed(opts["by"])
    keys = sorted_by(by, opts.get("ascending", True))
    return ctx.ordered(rel, keys, opts.get("reset_index", True))


def limit(args, opts, ctx):
    """The first ``n`` rows in the relation's order: a top-n, never a full sort."""
    rel = ctx.relation(args[0])
    keys = rel.order or [F.col(ctx.row_ids(rel))]
    return ctx.derive(rel, rel.df.orderBy(*keys).limit(int(opts.get("n", 100))))
