"""Coercion and null rules that operators and contracts share.

All functions take and return Columns; nothing here raises under ANSI mode.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Words that read as null when a text column is copied (fixed values).
NULL_WORDS = ("nan", "None", "N/A", "", "<NA>")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "yyyyMMdd")

FLOATS = (T.FloatType, T.DoubleType)
NUMERIC = (T.NumericType,)


def lit(value) -> Column:
    """A literal; also of None, dates and lists of literals."""
    if isinstance(value, (list, tuple)):
        return F.array(*map(lit, value))
    if value is None or isinstance(value, (bool, int, float, str, date, datetime, Decimal)):
        return F.lit(value)
    raise TypeError(f"no literal of type {type(value).__name__}")


def is_missing(c: Column, kind: T.DataType | None) -> Column:
    """Null, or NaN in a floating-point column."""
    return c.isNull() | F.isnan(c) if isinstance(kind, FLOATS) else c.isNull()


#: Python's white space (fixed values).
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def number(c: Column, kind: T.DataType | None) -> Column:
    """As double; null where the value is not a number (also NaN, and suffixed forms such as 1d)."""
    if isinstance(kind, FLOATS):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        s = F.trim(c)
        return F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.lit(None).cast("double")


def zero_if_null(c: Column, kind: T.DataType | None) -> Column:
    return F.coalesce(number(c, kind), F.lit(0.0))


def whole(c: Column) -> Column:
    """A double as long; an error on a fraction, so nothing is cut off unseen."""
    fits = (c == F.floor(c)) & (F.abs(c) < F.lit(9.2e18))
    return F.when(c.isNull(), F.lit(None).cast("long")).when(fits, c.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), c.cast("string"))).cast("long"))


def as_date(c: Column, kind: T.DataType | None, formats=DATE_FORMATS) -> Column:
    """As timestamp: dates and timestamps as they are, text by the first of ``formats`` that fits."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    text = F.trim(c.cast("string"))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def as_text(c: Column, null_token: str = "<NA>") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null_token))


_NAMED, _BACK = re.compile(r"\(\?P<(\w+)>"), re.compile(r"\(\?P=(\w+)\)")


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's spelling; an error if Python itself rejects it."""
    re.compile(pattern)
    named = lambda m: f"(?<{m[1].replace('_', '')}>"
    return _BACK.sub(lambda m: rf"\k<{m[1].replace('_', '')}>", _NAMED.sub(named, pattern))


def java_replacement(text: str) -> str:
    r"""``\1`` and ``\g<1>`` become ``$1``; other dollars and backslashes are literal."""
    out, at = [], 0
    for m in re.finditer(r"\\(\d)|\\g<(\w+)>|\\(.)|(\$)", text):
        out.append(text[at : m.start()])
        group = m[1] or m[2]
        out.append((f"${group}" if group.isdigit() else f"${{{group.replace('_', '')}}}") if group else "\\$" if m[4] else "\\" + m[3])
        at = m.end()
    return "".join([*out, text[at:]])
