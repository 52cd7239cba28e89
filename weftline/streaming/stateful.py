"""Streams with state: repeated and late rows, keys that another stream holds, sessions.

State lives in the query's checkpoint, so a restarted query goes on where it stopped. What is kept for a
key is its name, a number and a time, and it goes once event time has passed it by ``keep_hours``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys are dealt to so many groups; each reads and writes the state of its keys at once. A checkpoint is bound to this number.
BUCKETS = 2048


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keeps large state on disk and takes arbitrary state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Occurrences(StatefulProcessor):
    """Numbers the rows of each key as they come; forgets a key when event time has passed its last row by ``keep_ms``.

    A group is a bucket of keys: groups of single keys cost some milliseconds each, whatever they hold.
    """

    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "codes array<string>, n array<long>, last_ms array<long>")

    def _known(self) -> tuple[dict[str, int], dict[str, int]]:
        codes, n, last = self.seen.get() if self.seen.exists() else ((), (), ())
        return dict(zip(codes, n, strict=True)), dict(zip(codes, last, strict=True))

    def _update(self, n: dict[str, int], last: dict[str, int]) -> None:
        """A bucket has one timer, for the key that is to be forgotten next."""
        if not n:
            self.seen.clear()
            return
        self.seen.update((list(n), list(n.values()), [last[c] for c in n]))
        self.handle.registerTimer(min(last.values()) + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, last = self._known()
        if last:
            self.handle.deleteTimer(min(last.values()) + self.keep_ms)
        for pdf in rows:
            pdf = pdf.sort_values("us", kind="stable")
            groups = pdf.groupby("code", sort=False)["us"]
            before = pdf["code"].map(n).fillna(0).astype("int64")
            yield pdf[self.columns].assign(occurrence=before + groups.cumcount() + 1)
            for code, size, top in zip((found := groups.agg(["size", "max"])).index, found["size"].tolist(), found["max"].tolist(), strict=True):
                n[code] = n.get(code, 0) + size
                last[code] = max(last.get(code, top // 1000), top // 1000)
        self._update(n, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self._known()
        now = timerValues.getCurrentWatermarkInMs()
        left = {c: t for c, t in last.items() if t + self.keep_ms > now}
        self._update({c: n[c] for c in left}, left)
        return iter(())

    def close(self) -> None:
        pass


def _code(df: DataFrame, keys: list[str]) -> Column:
    """A text for each combination of keys; equal texts are equal keys."""

    def text(c: str) -> Column:
        kind, value = df.schema[c].dataType, F.col(c)
        if isinstance(kind, T.BinaryType):
            return F.base64(value)
        if isinstance(kind, T.TimestampType):  # wall clocks repeat an hour
            return F.unix_micros(value).cast("string")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (value + F.lit(0.0)).cast("string")  # minus zero is zero
        if isinstance(kind, (T.ArrayType, T.StructType)):
            return F.to_json(value)
        return value.cast("string")

    return text(keys[0]) if len(keys) == 1 else F.to_json(F.array(*map(text, keys)))


def occurrences(df: DataFrame, key: str | list[str], time_column: str, late: str = "10 minutes", keep_hours: float = 24) -> DataFrame:
    """``df`` with ``_occurrence``: 1 for the first row of a key, 2 for its first repetition, and so on.

    Rows later than ``late`` are left out by the watermark. Rows without a key or time have no occurrence and
    are left out too; check them with not_null beforehand.
    """
    use_rocksdb(df.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    names = [f"c{i}" for i in range(len(df.columns))]  # rows reach Python as named tuples, which not every name fits
    at = lambda c: names[df.columns.index(c)]
    plain = df.select(*(F.col(f"`{c}`").cast("timestamp").alias(n) if c == time_column else F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    for c in (*keys, time_column):
        plain = plain.where(F.col(at(c)).isNotNull())
    schema = T.StructType([*plain.schema.fields, T.StructField("occurrence", T.LongType())])
    coded = plain.withColumn("code", _code(plain, [at(c) for c in keys])).withColumn("us", F.unix_micros(at(time_column)))
    coded = coded.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(BUCKETS)).cast("int"))
    out = coded.withWatermark(at(time_column), late).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Occurrences(names, int(keep_hours * 3_600_000)), outputStructType=schema, outputMode="append", timeMode="EventTime",
    )
    return out.select(*(F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)), F.col("occurrence").alias("_occurrence"))


def unique_rows(df: DataFrame, key: str | list[str], time_column: str, **how) -> DataFrame:
    """The rule ``unique`` on a stream: adds ``_violations``, which names the rule for every row of a key but the first."""
    name = f"unique({key if isinstance(key, str) else ', '.join(key)})"
    rows = occurrences(df, key, time_column, **how)
    return rows.withColumn("_violations", F.when(F.col("_occurrence") > 1, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))).drop("_occurrence")


def sessions(df: DataFrame, key: str, time_column: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, start, end, n_rows): each key's rows with pauses below ``gap``, once event time has passed a session by ``late``."""
    t = df.withColumn(time_column, F.col(time_column).cast("timestamp")).where(F.col(f"`{key}`").isNotNull() & F.col(time_column).isNotNull()).withWatermark(time_column, late)
    out = t.groupBy(F.col(f"`{key}`"), F.session_window(time_column, gap).alias("session")).agg(F.count("*").alias("n_rows"))
    return out.select(F.col(f"`{key}`"), F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_rows")


def orphans(df: DataFrame, key: str, time_column: str, parents: DataFrame, parent_key: str, parent_time: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream whose key no row of another stream bears within so much time before or after.

    A row is given out once event time rules a partner out; rows without a key have none to look for and are left out.
    """
    a = df.withColumn(time_column, F.col(time_column).cast("timestamp")).where(F.col(f"`{key}`").isNotNull()).withWatermark(time_column, late)
    b = parents.select(F.col(f"`{parent_key}`").alias("_parent"), F.col(parent_time).cast("timestamp").alias("_at")).where("_parent IS NOT NULL").withWatermark("_at", late)
    near = (F.col("_at") >= F.col(time_column) - F.expr(f"INTERVAL {within}")) & (F.col("_at") <= F.col(time_column) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"`{key}`") == F.col("_parent")) & near, "left_outer").where("_parent IS NULL").drop("_parent", "_at")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there is processed and written to ``path``; the query then stops and can be started again on its checkpoint."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
