"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Spark's own limit is 100,000.
BUCKETS_MOST = 1 << 16
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; where that is unset on a single
    machine (tests) a folder is chosen and set once for the session; on a cluster
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/weftline-checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files survive lost executors; they stay until the shared folder is
    cleaned, as with ``checkpoint()``, since the caller's plan still reads them.
    With ``bucket`` the rows are dealt out by that column once, and the table is
    read with that partitioning: a file a task, and nothing is shuffled for it.
    """
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    _written.append(path)
    if not bucket:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = table.replace("-", "_")
    buckets = min(BUCKETS_MOST, partitions_for(spark))
    df.repartition(buckets, bucket).write.option("compression", "zstd").bucketBy(buckets, bucket).saveAsTable(table, format="parquet", path=path)
    out = spark.table(table)
    out.schema  # resolved: the name is not needed any more, the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and no plan reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tables/" in f}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> int:
    """Delete all tables that this process wrote; to be called once their results are saved. Gives their number."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Iterable[str] = ()) -> DataFrame:
    """Only the columns an operator needs, under fixed names; a null text counts as empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        *(docs[c].alias(c) for c in extra),
    )


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 128):
    """While it lasts, Arrow batches hold few rows: for actions whose rows carry texts and lists."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
