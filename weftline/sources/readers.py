"""Sources: a protocol, files, SQLite tables."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..graph import shared_folder

#: Texts that a CSV reader takes for null (fixed values).
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class Source(Protocol):
    def connect(self) -> bool: ...

    def read(self) -> DataFrame: ...


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


class CsvSource:
    """CSV with a header, on any file system Spark reads. Null texts become null; types are inferred, or given by ``schema`` (one pass less)."""

    def __init__(self, spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ",", schema: T.StructType | str | None = None):
        self.spark, self.path, self.encoding, self.delimiter, self.schema = spark, path, encoding, delimiter, schema

    def connect(self) -> bool:
        if not _exists(self.spark, self.path):
            raise FileNotFoundError(self.path)
        return True

    def read(self) -> DataFrame:
        self.connect()
        reader = self.spark.read.option("header", True).option("sep", self.delimiter).option("encoding", self.encoding).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
        try:
            if self.schema:
                return _nulled(reader.schema(self.schema).csv(self.path))
            raw = _nulled(reader.option("inferSchema", False).csv(self.path))
            return _typed(raw)
        except Exception as e:
            raise RuntimeError(f"cannot read {self.path}: {e}") from e


def _nulled(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.col(f"`{f.name}`").isin(*NULL_TEXTS), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns of whole numbers, numbers or booleans in their type, from one aggregation."""
    c = [F.col(f"`{x}`") for x in df.columns]
    if not c:
        return df
    every = lambda x, p: F.coalesce(F.bool_and(F.when(x.isNotNull(), p)), F.lit(False))
    got = df.agg(*(e.alias(f"{k}{i}") for i, x in enumerate(c) for k, e in (
        ("i", every(x, x.try_cast("long").isNotNull() & x.rlike(r"^[+-]?\d+$"))), ("d", every(x, x.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"))), ("b", every(x, F.lower(x).isin("true", "false"))),
    ))).first()
    kind = lambda i: "long" if got[f"i{i}"] else "double" if got[f"d{i}"] else "boolean" if got[f"b{i}"] else None
    return df.select(*(x.try_cast(kind(i)).alias(n) if kind(i) else x for i, (x, n) in enumerate(zip(c, df.columns, strict=True))))


class TableSource:
    """Parquet, ORC or JSON files, or a catalog table."""

    def __init__(self, spark: SparkSession, where: str, form: str = "parquet"):
        self.spark, self.where, self.form = spark, where, form

    def connect(self) -> bool:
        if self.form != "table" and not _exists(self.spark, self.where):
            raise FileNotFoundError(self.where)
        return True

    def read(self) -> DataFrame:
        self.connect()
        return self.spark.table(self.where) if self.form == "table" else self.spark.read.format(self.form).load(self.where)


def excel_source(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet of a workbook, where an Excel reader for pandas is installed. Workbooks hold at most a million rows."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("no Excel reader is installed") from e
    return spark.createDataFrame(frame)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def _sent_out(spark: SparkSession, path: str) -> str:
    """Gives every executor a copy of a local file; the name to find it by."""
    name = f"sqlite-{uuid.uuid4().hex}.db"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files/{name}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(path).resolve()}"), target)
    spark.sparkContext.addFile(str(target.toString()))
    return name


def read_sqlite(spark: SparkSession, path: str, table: str, batch: int = 50_000) -> DataFrame:
    """A table of a local SQLite file. The file goes to the executors, whose tasks read ``batch`` row ids each; a table without row ids is one task."""
    if table not in sqlite_tables(path):
        raise ValueError(f"no table {table}")
    with sqlite3.connect(path) as con:
        cols = con.execute(f'PRAGMA table_info("{table}")').fetchall()
        try:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        except sqlite3.OperationalError:
            low = high = None
            batch = 0
    kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType()}
    schema = T.StructType([T.StructField(c[1], kinds.get(c[2].upper(), T.StringType())) for c in cols])
    if batch and low is None:
        return spark.createDataFrame([], schema)
    file = _sent_out(spark, path)
    names, kind = [f.name for f in schema.fields], to_arrow_schema(schema)
    cells = [str if isinstance(f.dataType, T.StringType) else float if isinstance(f.dataType, T.DoubleType) else int for f in schema.fields]
    listed = ", ".join(f'"{n}"' for n in names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(SparkFiles.get(file)) as con:
            for b in batches:
                for i in b.column(0).to_pylist():
                    where = f" WHERE rowid >= {low + i * batch} AND rowid < {low + (i + 1) * batch}" if batch else ""
                    cur = con.execute(f'SELECT {listed} FROM "{table}"{where}')
                    while got := cur.fetchmany(10_000):
                        columns = [[None if v is None else cast(v) for v in c] for c, cast in zip(zip(*got, strict=True), cells, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)

    parts = (high - low) // batch + 1 if batch else 1
    return spark.range(0, parts, 1, min(parts, 1_000)).mapInArrow(rows, schema)


def export_sqlite(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Every table of a SQLite file to ``folder/<table>.csv`` (a folder of part files)."""
    names = sqlite_tables(path)
    for n in names:
        read_sqlite(spark, path, n).write.mode("overwrite").option("header", True).csv(str(Path(folder) / f"{n}.csv"))
    return names
