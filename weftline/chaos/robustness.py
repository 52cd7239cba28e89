"""How well plans and contracts stand corrupted data: corrupt, compile, check, score, and count what was caught.

``python -m weftline.chaos.robustness --registry models.json --target m --plan plan.json --key id --out folder``
runs the corruptors, or scenarios, over a clean table (or generated rows) and
writes one JSON summary.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import hidden, keep
from ..mapping import from_files, heuristic
from ..ontology import Registry
from ..pipeline import run_pipeline
from .arena import Arena, accuracy, generate
from .corruptors import MODES, Corrupted, change_log, corrupt, corruption_log
from .scenarios import SCENARIOS, run_scenario

SAMPLE = 20  # rows of the log shown in a summary


def detection_rates(log: DataFrame, caught: DataFrame, key: str) -> DataFrame:
    """corruption_type, corrupted, detected, rate: of the distinct rows each corruptor changed, those set aside."""
    rows = log.where("row IS NOT NULL").select("corruption_type", "row").distinct()
    hit = caught.select(F.col(f"`{key}`").cast("string").alias(hidden("k"))).distinct().withColumn(hidden("hit"), F.lit(1))
    met = rows.join(hit, F.col("row") == F.col(hidden("k")), "left").groupBy("corruption_type")
    return met.agg(F.count("*").alias("corrupted"), F.count(hidden("hit")).alias("detected")).withColumn("rate", F.col("detected") / F.col("corrupted"))


def _scored(messy: Corrupted, log: DataFrame, model: dict[str, Any], key: str, provider: Callable, **how) -> dict[str, Any]:
    if key not in model["fields"]:
        raise ValueError(f"the model must hold the key {key!r}: caught rows are known by it")
    done = run_pipeline(messy.table, model, provider, row_id=key, **how)
    log = keep(log)
    rates = {r["corruption_type"]: {k: r[k] for k in ("corrupted", "detected", "rate")} for r in detection_rates(log, done.quarantine, key).collect()}  # a row a kind
    return {
        "ir_metrics": accuracy(done.plan, model, messy.truth),
        "trust_score": done.report.trust_score,
        "decision": done.decision,
        "detection_rates": rates,
        "corruption_log_sample": [r.asDict() for r in log.orderBy("corruption_type", "row", "column").limit(SAMPLE).collect()],
    }


def corruptor_run(clean: DataFrame, model: dict[str, Any], key: str, provider: Callable = heuristic, mode: str = "Moderate", drift: float = 0.8, break_expressions: bool = True, seed: int = 42, **how) -> dict[str, Any]:
    """All corruptors at once; rates by corruptor. ``break_expressions`` also breaks the model's own rules."""
    rules = model["odcs_contracts"]["row_level_rules"] if break_expressions else []
    messy, log = corrupt(clean, key, mode, drift, rules, seed), corruption_log(clean, key, mode, drift, rules, seed)
    params = {"noise_level": mode, "drift_ratio": drift, "break_expressions": break_expressions, "seed": seed}
    return {"mode": "corruptor", "params": params, **_scored(messy, log, model, key, provider, **how)}


def scenario_run(clean: DataFrame, model: dict[str, Any], key: str, name: str, provider: Callable = heuristic, options: dict[str, Any] | None = None, **how) -> dict[str, Any]:
    """One scenario. Cells that differ from the clean table count as corrupted, and so do rows that occur twice."""
    messy = run_scenario(name, clean, key, **(options or {}))
    kind = name.upper()
    if name == "duplicate_import":
        log = messy.groupBy(F.col(f"`{key}`").cast("string").alias("row")).count().where("count > 1")
        log = log.select("row", F.lit(key).alias("column"), F.lit(kind).alias("corruption_type"), F.col("row").alias("original_value"), F.col("row").alias("new_value"))
    else:
        log = change_log(clean, messy, key, kind)
    truth = {c: c for c in messy.columns if c in clean.columns}
    return {"mode": "scenario", "scenario_name": name, "params": options or {}, **_scored(Corrupted(messy, truth), log, model, key, provider, **how)}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline.chaos.robustness", description=__doc__)
    p.add_argument("--registry", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--key", required=True)
    p.add_argument("--plan", action="append", help="plan file; without one, plans come from names alone")
    p.add_argument("--clean", help="Parquet or CSV table; without it rows are generated")
    p.add_argument("--rows", type=int, default=100)
    p.add_argument("--mode", choices=["corruptor", "scenario", "all"], default="corruptor")
    p.add_argument("--scenario", choices=sorted(SCENARIOS), action="append")
    p.add_argument("--options", default="{}", help="JSON: scenario name to its options")
    p.add_argument("--noise-level", choices=list(MODES), default="Moderate")
    p.add_argument("--drift-ratio", type=float, default=0.8)
    p.add_argument("--retries", type=int, default=2)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out", required=True)
    o = p.parse_args(args)
    from ..sources.readers import CsvSource

    spark = SparkSession.builder.appName("weftline robustness").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    model = Registry(o.registry).get(o.target)
    if o.clean:
        clean = spark.read.parquet(o.clean) if o.clean.rstrip("/").endswith(".parquet") else CsvSource(spark, o.clean).read()
    else:
        clean = generate(spark, model, o.rows, o.seed, o.key)
    fresh = lambda: from_files(o.plan) if o.plan else heuristic
    options = json.loads(o.options)
    done = []
    if o.mode in ("corruptor", "all"):
        done.append(corruptor_run(clean, model, o.key, fresh(), o.noise_level, o.drift_ratio, seed=o.seed, max_retries=o.retries))
    if o.mode in ("scenario", "all"):
        for name in o.scenario or ["duplicate_import"]:
            done.append(scenario_run(clean, model, o.key, name, fresh(), options.get(name), max_retries=o.retries))
    for d in done:
        Arena(o.out).record(d.get("scenario_name", "corruptor"), {**d["ir_metrics"], "trust_score": d["trust_score"]})
    path = Path(o.out) / f"benchmark_summary_{datetime.now():%Y%m%d_%H%M%S}.json"
    path.write_text(json.dumps(done, indent=2, default=str), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
