"""Profile, plan, lower, check, route; again with feedback while it can heal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts.trust import Evaluation, Report, evaluate
from .mapping import generate_plan
from .plans.compiler import compile_plan
from .plans.document import Plan, PlanError, validate
from .profiling import profile as profile_table
from .profiling import top_values


@dataclass
class Result:
    decision: str
    report: Report
    clean: DataFrame
    quarantine: DataFrame
    plan: Plan
    attempts: int
    feedback: dict[str, Any] | None = None


def failure_statistics(quarantine: DataFrame, column: str) -> DataFrame:
    """One row on the quarantined values of a column: counts, traits, average length."""
    text = F.col(f"`{column}`").cast("string")
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    return quarantine.agg(
        F.count("*").alias("n_rows"), F.count(text).alias("n_values"),
        every(F.when(text.isNotNull(), (F.lower(text) == text) & text.rlike(r"\p{L}"))).alias("all_lower"),
        every(F.when(text.isNotNull(), (F.upper(text) == text) & text.rlike(r"\p{L}"))).alias("all_upper"),
        F.coalesce(F.bool_or(text.rlike(r"^\s|\s$")), F.lit(False)).alias("edge_space"),
        every(F.when(text.isNotNull(), text.rlike(r"^\p{N}+$"))).alias("all_digits"),
        F.avg(F.length(text).cast("double")).alias("mean_length"),
    )


def failure_context(evaluation: Evaluation) -> dict[str, Any]:
    """What went wrong, for the next attempt: per error its rate, most frequent values and traits."""
    bad, report = evaluation.quarantine, evaluation.report
    out = []
    for e in report.errors:
        entry: dict[str, Any] = {"target_column": e.column, "violated_rule": e.rule, "failed_rows": e.affected_rows, "failure_rate": e.affected_rows / max(1, report.total_rows)}
        if e.column and e.column in bad.columns:
            s = failure_statistics(bad, e.column).first()
            if s["n_values"]:
                entry["top_values"] = [r["value"] for r in top_values(bad.select(e.column), 5).orderBy("rank").collect()]
                entry["traits"] = [k for k in ("all_lower", "all_upper", "edge_space", "all_digits") if s[k]]
                entry["mean_length"] = s["mean_length"]
            else:
                entry["traits"] = ["all_null"]
        out.append(entry)
    return {"failed_targets": out}


def run_pipeline(source: DataFrame, model: dict[str, Any], provider: Callable, tables: dict[str, DataFrame] | None = None, references: dict[str, DataFrame] | None = None, max_retries: int = 2, row_id: str | None = None) -> Result:
    """Up to ``max_retries`` more attempts while the decision is AUTO_HEAL. A bad plan ends it."""
    facts = profile_table(source)
    feedback = None
    for attempt in range(1, max_retries + 2):
        plan = generate_plan(provider, facts, model, feedback)
        if errors := validate(plan, source.columns, model["fields"], tables or {}):
            raise PlanError(errors)
        target = compile_plan(plan, source, tables, model["fields"], row_id)
        done = evaluate(target, model["odcs_contracts"], references)
        if done.report.routing_decision != "AUTO_HEAL" or attempt > max_retries:
            break
        feedback = failure_context(done)
    return Result(done.report.routing_decision, done.report, done.clean, done.quarantine, plan, attempt, feedback)
