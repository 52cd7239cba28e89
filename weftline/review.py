"""Human review of quarantined rows: decisions as a table, joined, then checked again."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import hidden
from .contracts.trust import Report, evaluate

REVIEW_CONFIDENCE = 0.99


def error_matrix(quarantine: DataFrame, row_key: str) -> DataFrame:
    """row key, column, rule: one row for each rule that a row really breaks."""
    label = F.explode("_violations").alias("label")
    return quarantine.select(F.col(f"`{row_key}`"), label).select(
        row_key, F.regexp_extract("label", r"\((.*)\)$", 1).alias("column"), F.regexp_extract("label", r"^(\w+)", 1).alias("rule")
    )


def apply_decisions(quarantine: DataFrame, decisions: DataFrame, row_key: str) -> DataFrame:
    """The quarantine without dropped rows, patches in place, and ``_action``.

    ``decisions``: row key, action (DROP, OVERRIDE or PATCH) and patches
    (map<string,string>). One decision a row counts.
    """
    d = decisions.select(F.col(f"`{row_key}`").alias(hidden("k")), F.upper("action").alias("_action"), F.col("patches").alias(hidden("p"))).dropDuplicates([hidden("k")])
    joined = quarantine.join(d, F.col(f"`{row_key}`") == F.col(hidden("k")), "left")
    patch = lambda c: F.try_element_at(hidden("p"), F.lit(c))
    has = lambda c: (F.col("_action") == "PATCH") & F.coalesce(F.map_contains_key(hidden("p"), F.lit(c)), F.lit(False))
    out = [
        F.col(c) if c.startswith("_") or c == row_key else F.when(has(c), patch(c).try_cast(quarantine.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
        for c in quarantine.columns
    ]
    return joined.where(F.coalesce(F.col("_action") != "DROP", F.lit(True))).select(*out, "_action")


def review(quarantine: DataFrame, decisions: DataFrame | None, model: dict[str, Any], row_key: str, references: dict[str, DataFrame] | None = None) -> tuple[DataFrame | None, DataFrame, Report | None]:
    """(rescued, still quarantined, report). Without decisions nothing changes and there is no report.

    Overridden rows are rescued unchecked; patched and undecided ones are checked again.
    """
    if decisions is None or not decisions.limit(1).count():
        return None, quarantine, None
    acted = apply_decisions(quarantine, decisions, row_key)
    free = acted.where(F.col("_action") == "OVERRIDE").drop("_action", "_violations")
    rest = acted.where(F.coalesce(F.col("_action") != "OVERRIDE", F.lit(True))).drop("_action", "_violations")
    done = evaluate(rest, model["odcs_contracts"], references, REVIEW_CONFIDENCE)
    return done.clean.unionByName(free), done.quarantine, done.report


def audit_trail(quarantine: DataFrame, decisions: DataFrame, row_key: str) -> DataFrame:
    """row key, action, details of every decision on a quarantined row."""
    known = quarantine.select(F.col(f"`{row_key}`").alias(hidden("k")))
    d = decisions.join(known, F.col(f"`{row_key}`") == F.col(hidden("k")), "left_semi")
    return d.select(row_key, F.upper("action").alias("action"), F.when(F.upper("action") == "PATCH", F.to_json("patches")).otherwise(F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string")).alias("details"), F.current_timestamp().alias("at"))


def payload(quarantine: DataFrame, report: Report, rows: int = 1000) -> dict[str, Any]:
    """For a screen: the first ``rows`` rows (a page, not the data) and which cells are wrong."""
    page = [r.asDict() for r in quarantine.limit(rows).collect()]
    if not page:
        return {"status": "EMPTY", "data": [], "error_matrix": {}}
    matrix: dict[int, dict[str, list[str]]] = {}
    for i, r in enumerate(page):
        for label in r.pop("_violations"):
            rule, _, column = label.partition("(")
            matrix.setdefault(i, {}).setdefault(column.rstrip(")"), []).append(rule)
    return {"status": "REQUIRES_HUMAN_REVIEW", "report_id": report.report_id, "total_quarantined": report.quarantined_rows_count, "global_alerts": [e["error"] for e in report.dataset_errors], "data": page, "error_matrix": matrix}
