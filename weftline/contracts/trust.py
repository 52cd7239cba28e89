"""Contracts over a table: one flagged pass, one aggregation, the score and the routes."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ExpressionError, parse
from ..graph import hidden, keep
from .rules import Rule, Violations

log = logging.getLogger(__name__)
PASS_SCORE, HEAL_SCORE, WARNING_WEIGHT = 0.95, 0.80, 0.2


@dataclass
class Finding:
    rule: str
    affected_rows: int
    column: str | None = None
    is_escalated: bool = False
    note: str | None = None


@dataclass
class Report:
    routing_decision: str
    trust_score: float
    total_rows: int
    quarantined_rows_count: int
    dataset_errors: list[dict[str, Any]] = field(default_factory=list)
    errors: list[Finding] = field(default_factory=list)
    warnings: list[Finding] = field(default_factory=list)
    report_id: str = field(default_factory=lambda: datetime.now().strftime("AUDIT-%Y%m%d%H%M%S"))
    timestamp: str = field(default_factory=lambda: datetime.now().isoformat())

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False, default=str)

    def to_markdown(self) -> str:
        rows = [
            f"# Audit report {self.report_id}",
            f"{self.timestamp}; decision **{self.routing_decision}**, trust score {self.trust_score:.2%}, {self.total_rows} rows, {self.quarantined_rows_count} in quarantine",
            "",
            "| kind | rule | column | rows | note |",
            "|-|-|-|-|-|",
            *(f"| dataset | {e['rule']} | | | {e['error']} |" for e in self.dataset_errors),
            *(f"| error | {e.rule} | {e.column or ''} | {e.affected_rows} | {'escalated warning' if e.is_escalated else ''} |" for e in self.errors),
            *(f"| warning | {w.rule} | {w.column or ''} | {w.affected_rows} | {w.note or ''} |" for w in self.warnings),
        ]
        return "\n".join(rows)


@dataclass
class Evaluation:
    report: Report
    table: DataFrame  # flagged: `_violations` and `_quarantined`

    @property
    def clean(self) -> DataFrame:
        return self.table.where("NOT _quarantined").drop("_violations", "_quarantined")

    @property
    def quarantine(self) -> DataFrame:
        """With `_violations`, the labels of each row's violated rules."""
        return self.table.where("_quarantined").drop("_quarantined")


def score(total: int, quarantined: int, warned: int, failed: bool, confidence: float = 1.0) -> tuple[float, str]:
    """The trust score and the decision."""
    if not total or failed:
        return 0.0, "QUARANTINE"
    s = round(max(0.0, confidence - quarantined / total - WARNING_WEIGHT * warned / total), 4)
    if s >= PASS_SCORE and not quarantined:
        return s, "PASS"
    return s, "AUTO_HEAL" if s >= HEAL_SCORE else "QUARANTINE"


def _near(value: float, expected: float, rtol: float, atol: float = 1e-8) -> bool:
    return abs(value - expected) <= atol + rtol * abs(expected)


def _invariant_columns(df: DataFrame, invariants: list[dict]) -> tuple[dict[int, list[Column]], list[str]]:
    """Aggregates of each invariant that can be checked; notes on the others."""
    out, notes = {}, []
    total = lambda c: F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0))
    for i, inv in enumerate(invariants):
        kind = inv.get("type")
        if kind == "double_entry":
            a, b = inv.get("debit_column", "debit"), inv.get("credit_column", "credit")
            if a in df.columns and b in df.columns:
                out[i] = [total(a), total(b)]
                continue
        elif kind in ("line_sum_consistency", "custom"):
            try:
                holds = parse(inv.get("rule", ""), {c: F.col(f"`{c}`") for c in df.columns})
                out[i] = [F.sum(F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1))]
                continue
            except ExpressionError as e:
                notes.append(f"{kind}: {e}")
                continue
        elif kind == "inventory_non_negative" and {"product_id", "quantity"} <= set(df.columns):
            continue
        notes.append(f"{kind}: not checked")
    return out, notes


def negative_stock(df: DataFrame, key: str = "product_id", quantity: str = "quantity") -> DataFrame:
    """Keys whose quantities sum to less than zero."""
    return df.groupBy(key).agg(F.sum(quantity).alias("total")).where("total < 0")


def orphan_ratio(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """One row: values of ``column`` without a partner, all values, and their ratio."""
    v = Violations(df.select(column), [Rule("foreign_key", column, target_entity="ref")], {"ref": reference})
    flagged = v.flagged()
    return flagged.agg(F.count(F.when(F.size("_violations") > 0, 1)).alias("orphans"), F.count(F.col(f"`{column}`")).alias("total")).withColumn(
        "orphan_rate", F.coalesce(F.try_divide(F.col("orphans").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    )


def evaluate(df: DataFrame, contracts: dict[str, Any], references: dict[str, DataFrame] | None = None, confidence: float = 1.0) -> Evaluation:
    """Check all rules of ``contracts`` (row_level_rules, dataset_level_rules, global_invariants).

    A warning whose share of rows is within its tolerance only counts; beyond it,
    its rows are quarantined as well (escalated). A dataset rule that fails makes
    the score zero.
    """
    rules = [r if isinstance(r, Rule) else Rule.of(r) for r in contracts.get("row_level_rules", ())]
    v = Violations(df, rules, references)
    flagged = keep(v.flagged())
    invariants = list(contracts.get("global_invariants", ()))
    inv, notes = _invariant_columns(df, invariants)
    sums = [d for d in contracts.get("dataset_level_rules", ()) if d.get("metric") == "sum_alignment" and d.get("target_sum_column") in df.columns]
    aggs = [F.count("*").alias("n")]
    aggs += [F.coalesce(F.sum(F.array_contains(hidden("codes"), i).cast("long")), F.lit(0)).alias(f"r{i}") for i in range(len(v.flags))]
    aggs += [F.coalesce(F.sum(F.col(f"`{d['target_sum_column']}`").cast("double")), F.lit(0.0)).alias(f"s{i}") for i, d in enumerate(sums)]
    aggs += [c.alias(f"i{i}_{j}") for i, cols in inv.items() for j, c in enumerate(cols)]
    got = flagged.agg(*aggs).first()
    total = got["n"]

    errors, warnings, hard, warned = [], [], [], 0
    for i, (r, _) in enumerate(v.flags):
        n = got[f"r{i}"]
        if not n:
            continue
        if r.severity == "warning" and n / max(total, 1) <= r.tolerance_ratio:
            warnings.append(Finding(r.label, n, r.column, note=f"{n / total:.2%} of rows, {r.tolerance_ratio:.2%} allowed"))
            warned += n
        else:
            errors.append(Finding(r.label, n, r.column, r.severity == "warning"))
            hard.append(i)
    warnings += [Finding(r.label, 0, r.column, note="unsupported assertion") for r in v.unsupported]
    for note in notes:
        log.warning("invariant %s", note)

    failed = []
    for d in contracts.get("dataset_level_rules", ()):
        if d.get("metric") == "volume_check" and total < (d.get("min_rows") or 0):
            failed.append({"rule": "volume_check", "error": f"{total} rows, at least {d['min_rows']} wanted"})
        elif d.get("metric") == "orphan_rate" and d.get("column") in df.columns and (ref := (references or {}).get(d.get("target_entity"))) is not None:
            rate = orphan_ratio(df, d["column"], ref).first()["orphan_rate"]
            if rate > d.get("max_rate", 0.0):
                failed.append({"rule": "orphan_rate", "error": f"{rate:.4f} of {d['column']} without a partner"})
    for i, d in enumerate(sums):
        if not _near(got[f"s{i}"], d.get("expected_sum") or 0.0, 1e-3):
            failed.append({"rule": "sum_alignment", "error": f"{d['target_sum_column']} sums to {got[f's{i}']}, {d.get('expected_sum')} expected"})
    for i, cols in inv.items():
        kind = invariants[i]["type"]
        if len(cols) == 2:
            bad = not _near(got[f"i{i}_0"], got[f"i{i}_1"], 1e-6)
        else:
            bad = bool(got[f"i{i}_0"])
        if bad:
            failed.append({"rule": kind, "error": f"{kind} does not hold"})
    for d in invariants:
        if d.get("type") == "inventory_non_negative" and {"product_id", "quantity"} <= set(df.columns) and negative_stock(df).limit(1).count():
            failed.append({"rule": "inventory_non_negative", "error": "a product's quantities sum to less than zero"})

    out = F.exists(hidden("codes"), lambda c: c.isin(*hard)) if hard else F.lit(False)
    table = flagged.withColumn("_quarantined", out).drop(hidden("codes"))
    quarantined = table.where("_quarantined").count() if hard else 0
    s, decision = score(total, quarantined, warned, bool(failed), confidence)
    return Evaluation(Report(decision, s, total, quarantined, failed, errors, warnings), table)
