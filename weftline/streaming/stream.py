"""Streams: plans of scalar steps run as they are; contracts run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import hidden
from ..contracts.rules import Rule, Violations
from ..contracts.trust import Report, evaluate
from ..operators.registry import OPERATORS
from ..plans.compiler import compile_plan
from ..plans.document import Plan, PlanError

#: Rules that look at one row only.
ROW_RULES = {"not_null", "non_negative", "range", "max_length", "atomic", "enum_match", "pattern", "cross_field", "expression", "date_tolerance"}
#: Table operators that keep no state.
STATELESS = {"FILTER", "EXPLODE"}


def compile_stream(plan: Plan, source: DataFrame, fields: dict[str, dict] | None = None) -> DataFrame:
    """A plan without state over a streaming source."""
    bad = [n.operation for n in (*plan.steps.values(), *plan.outputs.values()) if OPERATORS[n.operation].table and n.operation not in STATELESS]
    if bad:
        raise PlanError([f"{op} needs state and is not for streams" for op in sorted(set(bad))])
    return compile_plan(plan, source, fields=fields)


def flag_stream(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Row rules on a stream: adds ``_violations``; rules over many rows are an error."""
    parsed = [Rule.of(r) for r in rules]
    if wide := sorted({r.assertion for r in parsed} - ROW_RULES):
        raise PlanError([f"{a} looks at many rows; check it per micro-batch" for a in wide])
    return Violations(df, parsed).flagged().drop(hidden("codes"))


def violation_rates(flagged: DataFrame, time_column: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows and violating rows by time window; data later than ``late`` is left out."""
    t = flagged.withColumn(hidden("t"), F.col(f"`{time_column}`").cast("timestamp")).withWatermark(hidden("t"), late)
    return t.groupBy(F.window(hidden("t"), window)).agg(F.count("*").alias("n_rows"), F.sum((F.size("_violations") > 0).cast("long")).alias("n_violating"))


def contract_stream(df: DataFrame, contracts: dict[str, Any], clean: str, quarantine: str, checkpoint: str, references: dict[str, DataFrame] | None = None, on_report: Callable[[int, Report], None] | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is evaluated as a table; clean and quarantined rows go to a folder of the batch, so a repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        done = evaluate(rows, contracts, references)
        done.clean.write.mode("overwrite").parquet(f"{clean}/batch={number}")
        done.quarantine.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if on_report:
            on_report(number, done.report)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
