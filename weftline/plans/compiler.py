"""Lowering of a plan to one lazy DataFrame.

A value is a ``Relation`` (a table) or a ``Series`` (a column of one). Steps that
give a column extend their relation by it, so columns of one relation never need
a join; Spark collapses the projections. Columns of relations whose rows descend
from the same source meet by row id; others cannot be put side by side (unless
``positional`` pairs rows by number).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.coerce import is_missing, lit, number, whole
from ..graph import hidden, is_hidden, keep, running
from ..operators.registry import OPERATORS
from .document import Node, Plan, PlanError, order, sub_order, validate

RID = hidden("rid")
_ids = itertools.count()


class _NeedsIds(Exception):
    """Relations of one source meet, so its rows need ids from the start."""


class CompilationError(RuntimeError):
    """An operator could not be lowered; names the step."""


@dataclass
class Relation:
    df: DataFrame
    root: int = field(default_factory=lambda: next(_ids))
    kept: bool = True  # rows and ids are those of the root, one to one
    order: list[Column] | None = None


@dataclass
class Series:
    relation: Relation
    name: str

    @property
    def kind(self) -> T.DataType:
        return self.relation.df.schema[self.name].dataType


class Context:
    """What operators need from the compiler."""

    def __init__(self, source: DataFrame, tables: dict[str, DataFrame], row_id: str | None, positional: bool, with_ids: bool):
        self.with_ids = with_ids
        self.spark, self.row_id, self.positional = source.sparkSession, row_id, positional
        self.tables = {k: Relation(v) for k, v in tables.items()} | {"source": Relation(source)}
        if with_ids:
            for rel in self.tables.values():
                self.row_ids(rel)
        self.source = self.tables["source"]
        self.values: dict[str, Relation | Series] = {}
        self.kept: list[DataFrame] = []

    # ---- values ----

    def relation(self, v) -> Relation:
        if isinstance(v, Relation):
            return v
        return Relation(v.relation.df.select(F.col(f"`{v.name}`").alias(v.name.removeprefix(hidden("s_")))), v.relation.root)

    def plain(self, rel: Relation) -> DataFrame:
        """The relation's own columns, without ids and step columns."""
        return rel.df.select(*(F.col(f"`{c}`") for c in rel.df.columns if not is_hidden(c)))

    def names(self) -> dict[str, Column]:
        rel = self.current
        out = {c: F.col(f"`{c}`") for c in rel.df.columns if not is_hidden(c)}
        for name, v in self.values.items():
            if isinstance(v, Series) and v.relation is rel:
                out[name] = F.col(f"`{v.name}`")
        return out

    # ---- results ----

    def fresh_name(self) -> str:
        return hidden(f"s_{self.step}_{next(_ids)}")

    def add(self, rel: Relation, value: Column, hint: str = "") -> Series:
        name = hidden(f"s_{hint or self.step}_{next(_ids)}")
        rel.df = rel.df.withColumn(name, value)
        return Series(rel, name)

    extend = add

    def column(self, series: Series, fn) -> Series:
        return self.add(series.relation, fn(F.col(f"`{series.name}`")))

    def derive(self, rel: Relation, df: DataFrame) -> Relation:
        return Relation(df, rel.root, False, rel.order)

    def fresh(self, df: DataFrame) -> Relation:
        return Relation(df.drop(RID))

    def row_ids(self, rel: Relation) -> str:
        """The name of the relation's row ids. A declared unique column of the source serves as it is."""
        if self.row_id and self.row_id in rel.df.columns:
            return self.row_id
        if RID not in rel.df.columns:
            rel.df = rel.df.withColumn(RID, F.monotonically_increasing_id())
        return RID

    def ordered(self, rel: Relation, keys: list[Column], reset: bool) -> Relation:
        rid = self.row_ids(rel)
        df = rel.df.orderBy(*keys, F.col(rid))
        if not reset:
            return Relation(df, rel.root, rel.kept, [*keys, F.col(rid)])
        out = Relation(df.drop(RID).withColumn(RID, F.monotonically_increasing_id()))  # ids rise along a sorted result
        out.order = [*keys, F.col(RID)]
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        return keep(df)

    def mapped(self, series: Series, table: DataFrame) -> Series:
        """Values replaced through (value, leader); the table is joined, its size decides how."""
        rel, name = series.relation, hidden(f"s_{self.step}_{next(_ids)}")
        t = table.select(F.col("value").alias(hidden("v")), F.col("leader").alias(hidden("l")))
        c = F.col(f"`{series.name}`").cast("string")
        rel.df = rel.df.join(t, c == F.col(hidden("v")), "left").withColumn(name, F.coalesce(hidden("l"), c)).drop(hidden("v"), hidden("l"))
        return Series(rel, name)

    def lookup(self, key: Column, table: dict) -> Column:
        """A large mapping is joined to the current relation."""
        small = self.spark.createDataFrame([(str(k), str(v)) for k, v in table.items()], "value string, leader string")
        return F.col(f"`{self.mapped(self.add(self.current, key), small).name}`")

    def carry(self, series: Series, forward: bool) -> Series:
        """Forward or backward fill over all rows without a single-task window.

        Rows are dealt out in id order; each part is filled by itself, and the
        last value known of each part (one row a part) is carried over.
        """
        rel = series.relation
        rid, value = self.row_ids(rel), F.col(f"`{series.name}`")
        df = rel.df.repartitionByRange(F.col(rid)).withColumn(hidden("p"), F.spark_partition_id())
        df = keep(df)
        w = Window.partitionBy(hidden("p")).orderBy(F.col(rid) if forward else F.col(rid).desc()).rowsBetween(Window.unboundedPreceding, 0)
        filled = df.withColumn(hidden("f"), F.last(value, ignorenulls=True).over(w))
        ends = df.where(value.isNotNull()).groupBy(hidden("p")).agg((F.max_by if forward else F.min_by)(value, F.col(rid)).alias(hidden("e")))
        parts = df.select(F.col(hidden("p")).alias(hidden("q"))).distinct().join(ends, F.col(hidden("p")) == F.col(hidden("q")), "left")  # one row a part
        others = Window.orderBy(F.col(hidden("q")) if forward else F.col(hidden("q")).desc()).rowsBetween(Window.unboundedPreceding, -1)
        seed = parts.select(hidden("q"), F.last(hidden("e"), ignorenulls=True).over(others).alias(hidden("e")))
        name = hidden(f"s_{self.step}_{next(_ids)}")
        rel.df = filled.join(F.broadcast(seed), F.col(hidden("p")) == F.col(hidden("q")), "left").withColumn(name, F.coalesce(hidden("f"), hidden("e"))).drop(hidden("p"), hidden("q"), hidden("f"), hidden("e"))
        return Series(rel, name)

    # ---- alignment ----

    def align(self, series: list[Series]) -> tuple[Relation, list[str]]:
        """One relation that holds all series; the first one's rows count."""
        base, names = series[0].relation, []
        for s in series:
            if s.relation is base:
                names.append(s.name)
                continue
            if s.relation.root == base.root:
                if not self.with_ids and not self.row_id:
                    raise _NeedsIds
                key = self.row_ids(base)
                other = s.relation.df.select(F.col(self.row_ids(s.relation)).alias(hidden("k")), F.col(f"`{s.name}`").alias(f"{s.name}_j"))
                base.df = base.df.join(other, F.col(f"`{key}`") == F.col(hidden("k")), "left").drop(hidden("k"))
            elif self.positional:
                number = lambda rel, n: running(rel.df, rel.order or [F.col(self.row_ids(rel))], {n: F.lit(1)})
                self.row_ids(base), self.row_ids(s.relation)
                other = number(s.relation, hidden("k")).select(hidden("k"), F.col(f"`{s.name}`").alias(f"{s.name}_j"))
                base.df = number(base, hidden("n")).join(other, F.col(hidden("n")) == F.col(hidden("k")), "left").drop(hidden("k"), hidden("n"))
            else:
                raise CompilationError("columns of unrelated tables cannot stand side by side; join the tables first")
            names.append(f"{s.name}_j")
        return base, names

    # ---- nodes ----

    def argument(self, a) -> Relation | Series | Any:
        if a.type == "TABLE_REF":
            return self.tables[a.value]
        if a.type == "STEP_REF":
            return self.values[a.value]
        if a.type == "COLUMN_REF":
            return Series(self.source, a.value)
        return a

    def run(self, step: str, node: Node) -> Relation | Series:
        self.step = step
        spec, args = OPERATORS[node.operation], [self.argument(a) for a in node.inputs]
        self.current = next((v.relation for v in args if isinstance(v, Series)), None) or self._formula_home(node) or self.source
        try:
            if spec.table:
                args = [self.add(self.current, lit(a.value)) if not isinstance(a, (Relation, Series)) else a for a in args]
                return spec.lower(args, node.options, self)
            if node.operation == "COPY" and isinstance(args[0], Relation):
                column = node.options.get("column")
                if not column:
                    return args[0]
                args[0] = Series(args[0], column)
                self.current = args[0].relation
            series = [a for a in args if isinstance(a, Series)]
            if any(isinstance(a, Relation) for a in args):
                raise CompilationError(f"{node.operation} takes columns, not tables")
            if series:
                base, names = self.align(series)
                found = iter(names)
                self.current = base
                kinds = {n: base.df.schema[n].dataType for n in names}
                cols = [(F.col(f"`{n}`"), kinds[n]) for n in (next(found) if isinstance(a, Series) else None for a in args) if n]
                it = iter(cols)
                pairs = [next(it) if isinstance(a, Series) else self._literal(a.value) for a in args]
            else:
                pairs = [self._literal(a.value) for a in args]
            return self.add(self.current, spec.lower(pairs, node.options, self))
        except (CompilationError, PlanError, _NeedsIds):
            raise
        except Exception as e:
            raise CompilationError(f"{step} ({node.operation}): {e}") from e

    def _formula_home(self, node: Node) -> Relation | None:
        from ..functions.expressions import ExpressionError, identifiers

        for f in node.formulas():
            try:
                for name in sorted(identifiers(f)):
                    if isinstance(self.values.get(name), Series):
                        return self.values[name].relation
            except ExpressionError as e:
                raise CompilationError(f"{self.step}: {e}") from e
        return None

    @staticmethod
    def _literal(value) -> tuple[Column, T.DataType]:
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        return lit(value), kinds.get(type(value), T.NullType())


def fallback(c: Column, kind: T.DataType, strategy: str, default) -> Column:
    """What an output does with nulls: KEEP_NULL and HALT nothing, USE_ZERO, DEFAULT_STRING."""
    if strategy == "USE_ZERO":
        return F.coalesce(number(c, kind), F.lit(0.0))
    if strategy == "DEFAULT_STRING":
        text = c.cast("string")
        return F.when(is_missing(c, kind), F.lit(str(default or "UNKNOWN"))).otherwise(text)
    return c


def anchor(c: Column, kind: T.DataType, target: str) -> Column:
    """float: a double. int: a long, and an error for a fraction. Others as they are."""
    if target == "float":
        return number(c, kind)
    if target == "int":
        return whole(number(c, kind))
    return c


def compile_plan(plan: Plan, source: DataFrame, tables: dict[str, DataFrame] | None = None, fields: dict[str, dict] | None = None, row_id: str | None = None, positional: bool = False) -> DataFrame:
    """The target table of a plan.

    ``fields``: for each output its ``type``, ``fallback_strategy`` and
    ``default_value``; without it outputs keep their nulls. ``row_id`` names a
    unique column of the source that also gives its order; without one, ids are
    made where an operator needs them. Steps that no output needs are not lowered.
    """
    tables = tables or {}
    if errors := validate(plan, source.columns, fields, tables):
        raise PlanError(errors)
    tables = {k: v for k, v in tables.items()}
    for name in sub_order(plan):
        sub = plan.sub_plans[name]
        of = source if sub.source == "source" else tables[sub.source]
        out = _compiled(sub, of, tables, None, row_id if sub.source == "source" else None, positional)
        tables[name] = keep(out) if sub.materialise else out
    return _compiled(plan, source, tables, fields, row_id, positional)


def _compiled(plan: Plan, source: DataFrame, tables: dict[str, DataFrame], fields: dict[str, dict] | None, row_id: str | None, positional: bool) -> DataFrame:
    try:
        return _lower(plan, Context(source, tables, row_id, positional, False), fields)
    except _NeedsIds:  # ids are made only then, as they keep filters from reaching the scan
        return _lower(plan, Context(source, tables, row_id, positional, True), fields)


def _lower(plan: Plan, ctx: Context, fields: dict[str, dict] | None) -> DataFrame:
    for name in order(plan):
        ctx.values[name] = ctx.run(name, plan.steps[name])
    outputs: dict[str, Series] = {}
    for target, node in plan.outputs.items():
        value = ctx.run(target, node)
        if isinstance(value, Relation):
            raise CompilationError(f"output {target} is a table; name one of its columns with COPY and option column")
        outputs[target] = value
    if not outputs:
        raise CompilationError("a plan without outputs")
    base, names = ctx.align(list(outputs.values()))
    out = []
    for (target, _), name in zip(outputs.items(), names, strict=True):
        c, kind = F.col(f"`{name}`"), base.df.schema[name].dataType
        spec = (fields or {}).get(target, {})
        strategy = spec.get("fallback_strategy", "KEEP_NULL")
        value = fallback(c, kind, strategy, spec.get("default_value"))
        kind = T.DoubleType() if strategy == "USE_ZERO" else T.StringType() if strategy == "DEFAULT_STRING" else kind
        out.append(anchor(value, kind, plan.outputs[target].target_type).alias(target))
    return base.df.select(*out)
