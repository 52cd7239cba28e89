"""Target models: fields, contracts, their registry, and models inferred from data."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts.rules import ASSERTIONS, Rule

TYPES = {"string": T.StringType(), "float": T.DoubleType(), "int": T.LongType(), "boolean": T.BooleanType(), "date": T.StringType(), "datetime": T.TimestampType()}
STRATEGIES = ("KEEP_NULL", "USE_ZERO", "DEFAULT_STRING", "HALT")


def check_model(name: str, model: dict[str, Any]) -> dict[str, Any]:
    """The model with defaults filled in; ValueError for what does not fit."""
    fields = {}
    for f, spec in (model.get("fields") or {}).items():
        spec = {"type": spec} if isinstance(spec, str) else dict(spec)
        if spec.get("type") not in TYPES:
            raise ValueError(f"{name}.{f}: unknown type {spec.get('type')!r}")
        if spec.setdefault("fallback_strategy", "KEEP_NULL") not in STRATEGIES:
            raise ValueError(f"{name}.{f}: unknown strategy {spec['fallback_strategy']!r}")
        fields[f] = {k: v for k, v in spec.items() if v is not None}
    contracts = {k: list((model.get("odcs_contracts") or {}).get(k, ())) for k in ("row_level_rules", "dataset_level_rules", "global_invariants")}
    for raw in contracts["row_level_rules"]:
        if raw.get("assertion") not in ASSERTIONS:
            raise ValueError(f"{name}: unknown assertion {raw.get('assertion')!r}")
        Rule.of(raw)
    for raw in contracts["dataset_level_rules"]:
        if raw.get("metric") not in ("volume_check", "sum_alignment", "orphan_rate"):
            raise ValueError(f"{name}: unknown metric {raw.get('metric')!r}")
    return {"dataset_name": model.get("dataset_name") or name, "fields": fields, "odcs_contracts": contracts}


def struct_type(model: dict[str, Any]) -> T.StructType:
    return T.StructType([T.StructField(f, TYPES[s["type"]]) for f, s in model["fields"].items()])


class Registry:
    """Models of a JSON file, by name. A missing file is FileNotFoundError, a bad one RuntimeError."""

    def __init__(self, path: str | Path):
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        if "fields" in raw and "dataset_name" in raw:
            raw = {raw["dataset_name"]: raw}
        try:
            self.models = {k: check_model(k, v) for k, v in raw.items()}
        except (ValueError, TypeError, AttributeError) as e:
            raise RuntimeError(f"bad registry {path}: {e}") from e

    def names(self) -> list[str]:
        return list(self.models)

    def get(self, name: str) -> dict[str, Any]:
        if name not in self.models:
            raise ValueError(f"no model {name!r}")
        return self.models[name]


class Adapter(Protocol):
    """A system that describes its own tables."""

    def introspect_schema(self) -> dict[str, Any]: ...

    def get_mapping_hints(self) -> dict[str, str]: ...


class CatalogAdapter:
    """Tables of Spark's catalog."""

    def __init__(self, spark, database: str | None = None):
        self.spark, self.database = spark, database

    def introspect_schema(self) -> dict[str, Any]:
        return {t.name: {c.name: c.dataType for c in self.spark.catalog.listColumns(t.name, self.database)} for t in self.spark.catalog.listTables(self.database)}

    def get_mapping_hints(self) -> dict[str, str]:
        return {c: f"{t}.{c}" for t, cols in self.introspect_schema().items() for c in cols}


def inspect_schema(df: DataFrame) -> DataFrame:
    """column, type, not_null, unique of every column, from one aggregation."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(F.col(f"`{c}`")).alias(f"c{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), (F.col(f"c{i}") == F.col("n")).alias("not_null"), ((F.col(f"d{i}") == F.col("n")) & (F.col("n") > 0)).alias("unique"))
        for i, c in enumerate(df.columns)
    ))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def infer_model(df: DataFrame, name: str, negative_tolerance: float = 0.05) -> dict[str, Any]:
    """A model from data: not_null and unique (error), non_negative (warning) where the data holds them."""
    kinds = {}
    for f in df.schema.fields:
        k = f.dataType
        kinds[f.name] = "int" if isinstance(k, T.IntegralType) else "float" if isinstance(k, T.NumericType) else "boolean" if isinstance(k, T.BooleanType) else "datetime" if isinstance(k, (T.TimestampType, T.TimestampNTZType)) else "date" if isinstance(k, T.DateType) else "string"
    facts = {r["column"]: r for r in inspect_schema(df).collect()}  # one row a column
    low = df.agg(*(F.min(F.col(f"`{c}`")).alias(c) for c, k in kinds.items() if k in ("int", "float")) or [F.lit(0).alias("_")]).first().asDict()
    rules = []
    for c, k in kinds.items():
        if facts[c]["not_null"]:
            rules.append({"assertion": "not_null", "column": c})
        if facts[c]["unique"] and k in ("string", "int"):
            rules.append({"assertion": "unique", "column": c})
        if k in ("int", "float") and low.get(c) is not None and low[c] >= 0:
            rules.append({"assertion": "non_negative", "column": c, "severity": "warning", "tolerance_ratio": negative_tolerance})
    return check_model(name, {"fields": {c: {"type": k} for c, k in kinds.items()}, "odcs_contracts": {"row_level_rules": rules, "dataset_level_rules": [{"metric": "volume_check", "min_rows": 1}]}})
