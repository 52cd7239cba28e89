"""Row rules as boolean Columns.

A rule is true where a row violates it. All rules of a contract become one array
column, so a table is read once; ``unique`` adds an aggregate joined back,
``foreign_key`` a join with the distinct reference values.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import hidden
from ..functions.coerce import as_date, is_missing, java_pattern
from ..functions.expressions import ExpressionError, parse

ASSERTIONS = ("not_null", "non_negative", "range", "max_length", "atomic", "enum_match", "foreign_key", "pattern", "unique", "cross_field", "expression", "date_tolerance")
DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Rule:
    assertion: str
    column: str | None = None
    severity: str = "error"
    tolerance_ratio: float = 0.0
    regex: str | None = None
    target_column: str | None = None
    operator: str | None = None
    target_entity: str | None = None
    allowed_values: tuple | None = None
    min: float | None = None
    max: float | None = None
    max_length: int | None = None
    formula: str | None = None
    tolerance_window_days: int | None = None
    forbidden_delimiter: str | None = None
    null_policy: str = "violation"

    @property
    def label(self) -> str:
        return f"{self.assertion}({self.column})" if self.column else self.assertion

    @staticmethod
    def of(raw: dict[str, Any]) -> Rule:
        """From a document; keys that no rule has are ignored."""
        known = {f.name for f in fields(Rule)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        if not 0 <= kept.get("tolerance_ratio", 0) <= 1 or kept.get("severity", "error") not in ("error", "warning"):
            raise ValueError(f"bad rule {raw}")
        return Rule(**kept)


class Violations:
    """Builds the violation flags of a contract over a table."""

    def __init__(self, df: DataFrame, rules: list[Rule], references: dict[str, DataFrame] | None = None):
        self.df, self.references = df, references or {}
        self.base = df.columns
        self.unsupported: list[Rule] = []
        self.flags: list[tuple[Rule, Column]] = []
        for r in rules:
            if r.assertion not in ASSERTIONS:
                self.unsupported.append(r)
                continue
            flag = self._flag(r)
            if flag is not None:
                self.flags.append((r, F.coalesce(flag, F.lit(False))))

    def _flag(self, r: Rule) -> Column | None:
        if r.assertion != "expression" and r.column not in self.base:
            return None  # a rule on an absent column passes
        return getattr(self, f"_{r.assertion}")(r)

    def _kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def _c(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def _not_null(self, r: Rule) -> Column:
        return is_missing(self._c(r.column), self._kind(r.column))

    def _non_negative(self, r: Rule) -> Column | None:
        return self._c(r.column) < 0 if isinstance(self._kind(r.column), T.NumericType) else None

    def _range(self, r: Rule) -> Column | None:
        if not isinstance(self._kind(r.column), T.NumericType):
            return None
        out = F.lit(False)
        if r.min is not None:
            out = out | (self._c(r.column) < r.min)
        if r.max is not None:
            out = out | (self._c(r.column) > r.max)
        return out

    def _max_length(self, r: Rule) -> Column | None:
        if not isinstance(self._kind(r.column), T.StringType) or r.max_length is None:
            return None
        return F.length(self._c(r.column)) > r.max_length

    def _atomic(self, r: Rule) -> Column | None:
        kind = self._kind(r.column)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return self._c(r.column).isNotNull()
        return self._c(r.column).cast("string").rlike(java_pattern(r.forbidden_delimiter or r"[,;|]"))

    def _enum_match(self, r: Rule) -> Column | None:
        if not r.allowed_values:
            return None
        return self._c(r.column).isNotNull() & ~self._c(r.column).isin(*r.allowed_values)

    def _foreign_key(self, r: Rule) -> Column:
        """A value absent from the reference; of an unknown reference, any value."""
        c = self._c(r.column)
        ref = self.references.get(r.target_entity or "")
        if ref is None:
            return c.isNotNull()
        mark = hidden(f"fk_{len(self.flags)}")
        keys = ref.select(F.col(f"`{ref.columns[0]}`").cast(self._kind(r.column)).alias(hidden("key"))).where(F.col(hidden("key")).isNotNull()).distinct().withColumn(mark, F.lit(True))
        self.df = self.df.join(keys, c == F.col(hidden("key")), "left").drop(hidden("key"))
        return c.isNotNull() & F.col(mark).isNull()

    def _pattern(self, r: Rule) -> Column | None:
        return ~self._c(r.column).cast("string").rlike(java_pattern(r.regex)) if r.regex else None

    def _unique(self, r: Rule) -> Column:
        """All copies of a value, nulls among one another too. Repeated values are found by a pre-aggregated count, so a common value is no single task's work."""
        mark = hidden(f"dup_{len(self.flags)}")
        c = self._c(r.column)
        often = self.df.groupBy(c.alias(hidden("key"))).count().where("count > 1").select(hidden("key"), F.lit(True).alias(mark))
        nulls = often.where(F.col(hidden("key")).isNull()).select(F.col(mark).alias(f"{mark}_n"))
        # at most one row, for nulls, so they need no null-safe join, which could not spread them
        self.df = self.df.join(often.where(F.col(hidden("key")).isNotNull()), c == F.col(hidden("key")), "left").drop(hidden("key")).join(F.broadcast(nulls.agg(F.max(f"{mark}_n").alias(f"{mark}_n"))))
        return F.when(c.isNull(), F.col(f"{mark}_n").isNotNull()).otherwise(F.col(mark).isNotNull())

    def _cross_field(self, r: Rule) -> Column | None:
        if r.target_column not in self.base:
            return None
        a, b = self._c(r.column), self._c(r.target_column)
        holds = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}.get(r.operator or "")
        return None if holds is None else a.isNotNull() & b.isNotNull() & ~holds

    def _expression(self, r: Rule) -> Column:
        """Rows where the formula does not hold; a formula that cannot be read fails on every row."""
        try:
            holds = parse(r.formula or "", {c: self._c(c) for c in self.base})
        except ExpressionError:
            return F.lit(True)
        return ~F.coalesce(holds, F.lit(r.null_policy == "pass"))

    def _date_tolerance(self, r: Rule) -> Column | None:
        if r.target_column not in self.base:
            return None
        a, b = (as_date(self._c(c), self._kind(c)) for c in (r.column, r.target_column))
        days = F.floor((F.unix_micros(a) - F.unix_micros(b)) / DAY_MICROS)
        return F.abs(days) > (r.tolerance_window_days or 0)

    def flagged(self, name: str = "_violations") -> DataFrame:
        """The table with an array of the labels of violated rules."""
        marks = [F.when(flag, F.lit(i)) for i, (_, flag) in enumerate(self.flags)]
        array = F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<int>")
        labels = F.array(*(F.lit(r.label) for r, _ in self.flags)) if self.flags else F.array().cast("array<string>")
        coded = self.df.select(*(self._c(c) for c in self.base), array.alias(hidden("codes")))
        return coded.select(*(self._c(c) for c in self.base), F.transform(hidden("codes"), lambda i: labels[i]).alias(name), hidden("codes"))
