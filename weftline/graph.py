"""Lineage cuts, internal names and running sums for engine operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


_written: list[str] = []
#: Part of every internal column's name, so that no user's column can bear one.
_TOKEN = uuid.uuid4().hex[:12]


def hidden(name: str) -> str:
    """The name of an internal column."""
    return f"__{_TOKEN}_{name}"


def is_hidden(name: str) -> bool:
    return name.startswith(f"__{_TOKEN}_")


def release(spark: SparkSession) -> int:
    """Delete all tables that ``keep`` wrote in this process; to be called once their results are saved. Gives their number."""
    n = len(_written)
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one is chosen only on a single machine that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/weftline-checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Computed once: written as a table to the shared folder and read back, so it survives lost executors."""
    spark = df.sparkSession
    df = df.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    path = f"{shared_folder(spark)}/tables/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (name: summand, null as zero) along ``order``, own row included.

    ``order`` must have no ties. Rows are dealt out by ranges of it, so no task holds
    the table; each part sums by itself and adds what earlier parts hold, one row a part.
    """
    parts = keep(df.repartitionByRange(*order).withColumn(hidden("p"), F.spark_partition_id()))
    upto = Window.partitionBy(hidden("p")).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(hidden("p")).rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy(hidden("p")).agg(*(F.sum(c).alias(hidden(f"e_{n}")) for n, c in sums.items()))
    ends = ends.select(F.col(hidden("p")).alias(hidden("q")), *(F.sum(hidden(f"e_{n}")).over(before).alias(hidden(f"b_{n}")) for n in sums))
    inside = parts.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    out = inside.join(F.broadcast(ends), F.col(hidden("p")) == F.col(hidden("q")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumns({n: zero(n) + zero(hidden(f"b_{n}")) for n in sums}).drop(hidden("p"), hidden("q"), *(hidden(f"b_{n}") for n in sums))
