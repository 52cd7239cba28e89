"""Sinks: tables in parallel, and single files through the driver row by row."""

from __future__ import annotations

import csv
import json
import sqlite3
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQLITE_TYPES = {"string": "TEXT", "float": "REAL", "int": "INTEGER", "boolean": "INTEGER", "date": "TEXT", "datetime": "TEXT"}


def write_table(df: DataFrame, where: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Append with the time of compilation; a catalog table if ``form`` is table."""
    out = df.withColumn("_compiled_at", F.current_timestamp()).write.mode("append")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.saveAsTable(where) if form == "table" else out.format(form).save(where)


def write_sqlite(df: DataFrame, model: dict[str, Any], path: str, batch: int = 10_000) -> int:
    """Append the model's fields to a SQLite table, made if missing; one transaction, rolled back on an error. The rows stream through the driver."""
    fields = [f for f in model["fields"] if f in df.columns]
    name = model["dataset_name"]
    con = sqlite3.connect(path)
    try:
        ddl = ", ".join(f'"{f}" {SQLITE_TYPES[s["type"]]}' for f, s in model["fields"].items())
        con.execute(f'CREATE TABLE IF NOT EXISTS "{name}" ({ddl}, _compiled_at TEXT DEFAULT CURRENT_TIMESTAMP)')
        sql = f'INSERT INTO "{name}" ({", ".join(f"{chr(34)}{f}{chr(34)}" for f in fields)}) VALUES ({", ".join("?" * len(fields))})'
        n, rows = 0, []
        plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, bool) else v if isinstance(v, (int, float, str)) else str(v)
        for r in df.select(*(F.col(f"`{f}`") for f in fields)).toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(map(plain, r)))
            if len(rows) >= batch:
                con.executemany(sql, rows)
                n, rows = n + len(rows), []
        con.executemany(sql, rows)
        con.commit()
        return n + len(rows)
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """A folder of CSV parts, written in parallel."""
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def write_single_csv(df: DataFrame, path: str, delimiter: str = ",") -> int:
    """One CSV file with a byte-order mark, streamed through the driver; an empty table gives the header only."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=delimiter)
        out.writerow(df.columns)
        for r in df.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def write_json(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(value if isinstance(value, str) else json.dumps(value, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
