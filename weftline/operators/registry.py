"""The one table of operators, for validation and lowering.

A scalar operator turns aligned columns into a column; a table operator turns
values (columns or relations) into a relation or a column of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from . import bags, entity, meeting, nested, relational, sampling, scalar, sketches, subqueries, user, window


@dataclass(frozen=True)
class Operator:
    lower: Callable
    least: int = 1
    required: tuple[str, ...] = ()
    table: bool = False
    check: Callable[[dict[str, Any]], list[str]] | None = None


OPERATORS: dict[str, Operator] = {
    "COPY": Operator(scalar.copy),
    "CONCAT": Operator(scalar.concat, 2),
    "ADD": Operator(scalar.add, 2),
    "SUBTRACT": Operator(scalar.subtract, 2),
    "MULTIPLY": Operator(scalar.multiply, 2),
    "DIVIDE": Operator(scalar.divide, 2),
    "TO_FLOAT": Operator(scalar.to_float),
    "TO_INT": Operator(scalar.to_int),
    "PARSE_DATE": Operator(scalar.parse_date),
    "CLEAN_CURRENCY": Operator(scalar.clean_currency),
    "FUZZY_MAP": Operator(scalar.fuzzy_map),
    "RESOLVE_ENTITIES": Operator(entity.resolve_entities, table=True),
    "REGEX_EXTRACT": Operator(scalar.regex_extract, required=("pattern",), check=scalar.check_pattern),
    "REPLACE": Operator(scalar.replace, required=("pattern",), check=scalar.check_pattern),
    "FILLNA": Operator(window.fill, table=True, check=window.check_fill),
    "COMPUTE_EXPR": Operator(scalar.compute, 0, ("formula",)),
    "CASE_WHEN": Operator(scalar.case_when, 0, ("cases",)),
    "FILTER": Operator(relational.filter_rows, required=("condition",), table=True),
    "JOIN": Operator(relational.join, 2, table=True, check=relational.check_join),
    "RANGE_JOIN": Operator(meeting.range_join, 2, table=True, check=meeting.check_range_join),
    "ASOF_JOIN": Operator(meeting.asof_join, 2, table=True, check=meeting.check_asof_join),
    "THETA_JOIN": Operator(meeting.theta_join, 2, ("condition",), table=True, check=meeting.check_theta_join),
    "WHERE_EXISTS": Operator(subqueries.where_exists, 2, table=True, check=subqueries.check_correlation),
    "WHERE_IN": Operator(subqueries.where_in, 2, ("column",), table=True, check=subqueries.check_correlation),
    "SCALAR_SUBQUERY": Operator(subqueries.scalar_subquery, 2, ("column", "agg"), table=True, check=subqueries.check_correlation),
    "AGGREGATE_BY": Operator(user.aggregate_by, required=("by", "column", "function"), table=True, check=user.check_aggregate),
    "APPLY_TABLE": Operator(user.apply_table, required=("function",), table=True, check=user.check_table),
    "SAMPLE": Operator(sampling.sample, table=True, check=sampling.check_sample),
    "SKETCH_VALUE": Operator(sketches.value, required=("kind",), check=sketches.check_value),
    "PARSE_JSON": Operator(nested.parse_json),
    "JSON_GET": Operator(nested.json_get, required=("path",), check=nested.check_path),
    "EXPAND_JSON": Operator(nested.expand_json, required=("column",), table=True),
    "UNION": Operator(relational.union, 2, table=True),
    "INTERSECT": Operator(bags.intersect, 2, table=True),
    "EXCEPT": Operator(bags.except_, 2, table=True),
    "GROUP_BY": Operator(relational.group_by, required=("by", "agg"), table=True, check=relational.check_group_by),
    "EXPLODE": Operator(relational.explode, required=("column",), table=True),
    "PIVOT": Operator(relational.pivot, required=("index", "columns", "values"), table=True),
    "UNPIVOT": Operator(relational.unpivot, required=("id_vars",), table=True),
    "ORDER_BY": Operator(window.order_by, required=("by",), table=True),
    "LIMIT": Operator(window.limit, table=True),
    "WINDOW_APPLY": Operator(window.window_apply, required=("function", "target_column"), table=True, check=window.check_window),
}


def register_operator(name: str, lower: Callable, least: int = 1, required: tuple[str, ...] = ()) -> None:
    """Add a scalar operator: ``lower(columns, options, context) -> Column``."""
    if name in OPERATORS:
        raise ValueError(f"operator {name} exists")
    OPERATORS[name] = Operator(lower, least, required)
