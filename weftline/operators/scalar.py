"""Scalar operators: columns of one relation to a column of it.

Each takes ``args`` (list of ``(Column, DataType)``), ``opts`` and ``ctx``, which
offers ``names()``: all columns and steps by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import DATE_FORMATS, NULL_WORDS, as_date, as_text, java_pattern, java_replacement, lit, number, strip, zero_if_null
from ..functions.expressions import parse

#: Mappings of more entries than this are joined instead of written into the plan.
INLINE_MAP = 1000


def copy(args, opts, ctx) -> Column:
    """As it is; text is stripped, and null words become null."""
    c, kind = args[0]
    if not isinstance(kind, T.StringType):
        return c
    s = strip(c)
    return F.when(~s.isin(*NULL_WORDS), s)


def concat(args, opts, ctx) -> Column:
    """The first two as text; nulls by ``null_token``."""
    token = opts.get("null_token", "<NA>")
    return F.concat(*(as_text(c, token) for c, _ in args[:2]))


def add(args, opts, ctx) -> Column:
    return zero_if_null(*args[0]) + zero_if_null(*args[1])


def subtract(args, opts, ctx) -> Column:
    return zero_if_null(*args[0]) - zero_if_null(*args[1])


def multiply(args, opts, ctx) -> Column:
    return zero_if_null(*args[0]) * zero_if_null(*args[1])


def divide(args, opts, ctx) -> Column:
    """A null or zero divisor counts as one."""
    by = F.coalesce(number(*args[1]), F.lit(1.0))
    return zero_if_null(*args[0]) / F.when(by == 0, F.lit(1.0)).otherwise(by)


def to_float(args, opts, ctx) -> Column:
    return number(*args[0])


def to_int(args, opts, ctx) -> Column:
    """Null is 0; a fraction is cut off towards zero."""
    return zero_if_null(*args[0]).try_cast("long")


def parse_date(args, opts, ctx) -> Column:
    """ISO text of the UTC date, by the first of ``formats`` that fits; else null."""
    return as_date(*args[0], opts.get("formats") or DATE_FORMATS).cast("date").cast("string")


def clean_currency(args, opts, ctx) -> Column:
    c, kind = args[0]
    if not isinstance(kind, T.StringType):
        return number(c, kind)
    return number(F.regexp_replace(c, r"[^0-9.\-]", ""), T.StringType())


def fuzzy_map(args, opts, ctx) -> Column:
    """Stripped and in capitals, looked up in ``mapping_dict``; itself if absent there."""
    key = F.upper(strip(args[0][0].cast("string")))
    table = opts.get("mapping_dict") or {}
    if not table:
        return key
    if len(table) > INLINE_MAP:
        return ctx.lookup(key, table)
    return F.coalesce(F.try_element_at(F.create_map(*(lit(x) for kv in table.items() for x in (str(kv[0]), str(kv[1])))), key), key)


def check_pattern(opts) -> list[str]:
    if opts.get("is_regex", True) is False or not opts.get("pattern"):
        return []
    try:
        java_pattern(opts["pattern"])
    except re.error as e:
        return [f"bad pattern: {e}"]
    return []


def regex_extract(args, opts, ctx) -> Column:
    """The first group of the first match; null without one."""
    c, p = args[0][0].cast("string"), java_pattern(opts["pattern"])
    return F.when(c.rlike(p), F.regexp_extract(c, p, 1 if re.compile(opts["pattern"]).groups else 0))


def replace(args, opts, ctx) -> Column:
    c, p, r = args[0][0].cast("string"), opts["pattern"], str(opts.get("replacement", ""))
    if opts.get("is_regex", True) is False:
        return F.replace(c, F.lit(p), F.lit(r))
    return F.regexp_replace(c, java_pattern(p), java_replacement(r))


def compute(args, opts, ctx) -> Column:
    """``formula`` over source columns and steps; a step hides a column of its name."""
    return parse(opts["formula"], ctx.names())


def case_when(args, opts, ctx) -> Column:
    """The value of the first case whose condition holds; a text that names a column means that column."""
    names = dict(ctx.names())
    if args:
        names["_temp"] = args[0][0]
    pick = lambda v: names[v] if isinstance(v, str) and v in names else lit(v)
    kind = opts.get("result_type")
    typed = lambda c: c.cast(kind) if kind else c
    out = None
    for case in opts["cases"]:
        cond, value = parse(case["condition"], names), typed(pick(case["value"]))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(typed(pick(opts["default"]))) if opts.get("default") is not None else out
