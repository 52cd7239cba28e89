"""Mergeable sketches as columns: distinct values, quantiles, frequent values.

A sketch is built per group, stored like any column, merged again over coarser groups, and read with
SKETCH_VALUE, so a table is scanned once whatever it is later grouped by. Each group's state is bounded:
2**12 registers (relative error 1.6 % at one sigma), 200 items a level (rank error 1.7 % with 99 %), or
``TRACKED`` counters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTERS_LOG2, QUANTILE_K, TRACKED = 12, 200, 1_000
KINDS = ("distinct", "quantiles", "top")
AGGREGATES = (*(f"sketch_{k}" for k in KINDS), *(f"merge_{k}" for k in KINDS), "approx_nunique", "approx_median")


def _plain(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.BinaryType)) else c.cast("string")


def aggregate(c: Column, kind: T.DataType, how: str) -> Column:
    """Nulls (and NaN for quantiles) are not counted."""
    number = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if isinstance(kind, T.NumericType) else c
    match how:
        case "sketch_distinct":
            return F.hll_sketch_agg(_plain(c, kind), REGISTERS_LOG2)
        case "merge_distinct":
            return F.hll_union_agg(c)
        case "sketch_quantiles":
            return F.kll_sketch_agg_double(number, QUANTILE_K)
        case "merge_quantiles":
            return F.kll_merge_agg_double(c)
        case "sketch_top":
            return F.call_function("approx_top_k_accumulate", c, F.lit(TRACKED))
        case "merge_top":
            return F.call_function("approx_top_k_combine", c, F.lit(TRACKED))
        case "approx_nunique":
            return F.approx_count_distinct(c, 0.02)
        case "approx_median":
            return F.percentile_approx(number, 0.5, 10_000)
    raise ValueError(f"unknown sketch {how!r}")


def check_value(opts) -> list[str]:
    out = [] if opts.get("kind") in KINDS else [f"kind is one of {', '.join(KINDS)}"]
    q = opts.get("q", 0.5)
    if not isinstance(q, (int, float)) or not 0 <= q <= 1:
        out.append("q lies between 0 and 1")
    return out


def value(args, opts, ctx) -> Column:
    """What a sketch says: the number of distinct values, the quantile ``q``, or the ``k`` most frequent values with their counts."""
    c = args[0][0]
    if opts["kind"] == "distinct":
        return F.hll_sketch_estimate(c)
    if opts["kind"] == "quantiles":
        return F.kll_sketch_get_quantile_double(c, F.lit(float(opts.get("q", 0.5))))
    return F.call_function("approx_top_k_estimate", c, F.lit(int(opts.get("k", 5))))
