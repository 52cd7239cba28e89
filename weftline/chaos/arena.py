"""Generated clean data, contract breaking, and scores of plans against the truth."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import hidden
from ..mapping import lineage
from ..plans.document import Plan, read_plan
from .chance import draw, happens, uniform
from .corruptors import Corrupted, drift_names, inject_noise

#: Operators that suit a field type.
SUITABLE = {
    "float": {"CLEAN_CURRENCY", "COPY", "TO_FLOAT", "COMPUTE_EXPR"},
    "int": {"TO_INT", "COPY", "COMPUTE_EXPR"},
    "date": {"PARSE_DATE", "COPY"},
    "string": {"COPY", "FUZZY_MAP", "RESOLVE_ENTITIES", "REGEX_EXTRACT", "REPLACE"},
}
SCHEMA_WEIGHT, OPERATOR_WEIGHT = 0.7, 0.3
LEVELS = {"Dirty": 0.05, "Filthy": 0.20}


def generate(spark: SparkSession, model: dict[str, Any], rows: int | DataFrame, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Rows that keep the model's contracts, by field type and rules: so many, or one for every ``key`` of a table. Any size, no driver data."""
    base = rows.select(F.col(f"`{key}`")) if isinstance(rows, DataFrame) else spark.range(rows).withColumnRenamed("id", key)
    k = F.col(key)
    rules = model["odcs_contracts"]["row_level_rules"]

    def value(f: str, kind: str) -> Column:
        own = [r for r in rules if r.get("column") == f]
        for r in own:
            if r["assertion"] == "enum_match" and r.get("allowed_values"):
                return F.array(*(F.lit(v) for v in r["allowed_values"]))[(draw(seed, f, k) % len(r["allowed_values"])).cast("int")]
        lo = next((r["min"] for r in own if r["assertion"] == "range" and r.get("min") is not None), None)
        hi = next((r["max"] for r in own if r["assertion"] == "range" and r.get("max") is not None), None)
        if kind == "int":
            a, b = int(lo if lo is not None else 1), int(hi if hi is not None else 9999)
            return (draw(seed, f, k) % (b - a + 1) + a).cast("long")
        if kind == "float":
            a, b = (lo if lo is not None else 0.0), (hi if hi is not None else 10_000.0)
            return F.round(uniform(seed, f, k) * (b - a) + a, 2)
        if kind in ("date", "datetime"):
            day = F.date_add(F.lit("2020-01-01").cast("date"), (draw(seed, f, k) % 2192).cast("int"))
            return day.cast("timestamp") if kind == "datetime" else F.date_format(day, "yyyy-MM-dd")
        if kind == "boolean":
            return draw(seed, f, k) % 2 == 0
        if "warehouse" in f:
            return F.concat(F.lit("WH-A-"), k.cast("string"))
        return F.concat(F.lit(f"{f}-"), k.cast("string")) if "id" in f or any(r["assertion"] == "unique" for r in own) else F.concat(F.lit(f"{f} "), (draw(seed, f, k) % 100).cast("string"))

    out = base.select(k, *(value(f, s["type"]).alias(f) for f, s in model["fields"].items() if f != key))
    for r in rules:
        if r["assertion"] == "date_tolerance" and {r["column"], r.get("target_column")} <= set(out.columns):
            near = F.date_add(F.to_date(F.col(r["target_column"])), (draw(seed, f"near|{r['column']}", k) % (int(r.get("tolerance_window_days") or 0) + 1)).cast("int"))
            out = out.withColumn(r["column"], F.date_format(near, "yyyy-MM-dd"))
        elif r["assertion"] == "expression" and {"total_net_amount", "order_quantity", "unit_net_price"} <= set(out.columns) and "total_net_amount" in r["formula"]:
            out = out.withColumn("total_net_amount", F.col("order_quantity") * F.col("unit_net_price"))
    return out


def break_contracts(df: DataFrame, model: dict[str, Any], key: str, ratio: float, seed: int = 42) -> DataFrame:
    """A share of rows violates each non_negative, expression and date_tolerance rule."""
    from .corruptors import break_dependencies

    rules = model["odcs_contracts"]["row_level_rules"]
    k = F.col(key)
    for r in rules:
        if r["assertion"] == "non_negative" and r["column"] in df.columns:
            c = F.col(r["column"])
            df = df.withColumn(r["column"], F.when(happens(seed, f"negative|{r['column']}", k, ratio), (c * -1.5 - 10).cast(df.schema[r["column"]].dataType)).otherwise(c))
    return break_dependencies(df, key, rules, ratio, seed)


def chaos(df: DataFrame, model: dict[str, Any], key: str, level: str = "Dirty", seed: int = 42) -> Corrupted:
    """Broken contracts, then noise, then drifted names."""
    ratio = LEVELS.get(level, 0.5)
    return drift_names(inject_noise(break_contracts(df, model, key, ratio, seed), key, ratio, seed), seed=seed)


def accuracy(plan: Plan | str | dict, model: dict[str, Any], truth: dict[str, str]) -> dict[str, float]:
    """schema_score (columns traced to their fields), operator_score (of those, suitable operators), and both weighted."""
    try:
        plan = plan if isinstance(plan, Plan) else read_plan(plan)
    except ValueError:
        return {"schema_score": 0.0, "operator_score": 0.0, "composite_ir_accuracy": 0.0}
    traced = lineage(plan)
    right = [t for messy, t in truth.items() if traced.get(messy) == t]
    suits = [t for t in right if t in plan.outputs and plan.outputs[t].operation in SUITABLE.get(model["fields"].get(t, {}).get("type", "string"), ())]
    schema, operator = len(right) / max(1, len(truth)), len(suits) / max(1, len(right))
    return {"schema_score": round(schema, 4), "operator_score": round(operator, 4), "composite_ir_accuracy": round(SCHEMA_WEIGHT * schema + OPERATOR_WEIGHT * operator, 4)}


def detection(log: DataFrame, violations: DataFrame, key: str) -> DataFrame:
    """corrupted, detected and their ratio: how many corrupted rows a contract caught."""
    hit = violations.where(F.size("_violations") > 0).select(F.col(key).cast("string").alias(hidden("k")))
    rows = log.select("row").distinct().join(hit.distinct().withColumn(hidden("hit"), F.lit(1)), F.col("row") == F.col(hidden("k")), "left")
    return rows.agg(F.count("*").alias("corrupted"), F.count(hidden("hit")).alias("detected")).withColumn("rate", F.try_divide(F.col("detected").cast("double"), F.col("corrupted").cast("double")))


@dataclass
class Arena:
    """Appends scores to a JSON history for each name."""

    folder: str

    def record(self, name: str, scores: dict[str, float]) -> Path:
        path = Path(self.folder) / f"{name}_benchmark.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        history = json.loads(path.read_text()) if path.exists() else []
        history.append({**scores, "timestamp": datetime.now().isoformat()})
        path.write_text(json.dumps(history, indent=2))
        return path
