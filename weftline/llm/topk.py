"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into 16-bit segments with a table each. A search probes, segment
after segment, all values at distance 0 of the query's segment, then all at
distance 1, and so on. After segment ``s`` (from 0) at radius ``r`` of ``m``
segments, every code within ``m * r + s`` bits has been met; the search of a
query ends when that covers its k-th best verified distance, so neither
neighbours nor ties can be missed.

Rows are dealt to shards and queries to blocks, by hash of the id; a task
searches one block in one shard (numpy, many queries at once) and returns at most
k rows a query; these are merged by a window per query. The number of shards and
blocks follows from the row counts, so a task's memory stays the same at any size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

SEGMENT = 16
SHARD_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 16
AT_ONCE = 128
_MASKS = [np.array([sum(1 << b for b in some) for some in combinations(range(SEGMENT), r)], np.uint16) for r in range(SEGMENT + 1)]


class MultiIndex:
    """Codes (n x bytes, a multiple of two bytes) with a table for each segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        parts = self.codes.view(np.uint16)
        self.n, self.m = parts.shape
        self.order = [np.argsort(parts[:, s], kind="stable").astype(np.int32) for s in range(self.m)]
        self.start = [np.concatenate(([0], np.cumsum(np.bincount(parts[:, s], minlength=1 << SEGMENT)))) for s in range(self.m)]

    def search(self, queries: np.ndarray, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, code number, distance) of the k nearest codes of each query; ties by ``rank``."""
        parts = np.ascontiguousarray(queries).view(np.uint16)
        live = np.arange(len(queries))
        best = np.empty((0, 3), np.int64)  # query, code, distance; at most k a query once trimmed
        k = min(k, self.n)
        for r in range(SEGMENT + 1):
            for s in range(self.m):
                if not len(live):
                    return best[:, 0], best[:, 1], best[:, 2]
                values = parts[live, s][:, None] ^ _MASKS[r][None, :]
                low, high = self.start[s][values], self.start[s][values.astype(np.int64) + 1]
                count = (high - low).ravel()
                total = int(count.sum())
                if total:
                    owner = np.repeat(np.repeat(live, values.shape[1]), count)
                    inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    code = self.order[s][np.repeat(low.ravel(), count) + inside].astype(np.int64)
                    far = np.bitwise_count(self.codes[code] ^ queries[owner]).sum(axis=1).astype(np.int64)
                    best = self._trim(np.concatenate((best, np.stack((owner, code, far), axis=1))), k, rank)
                found = np.bincount(best[:, 0], minlength=len(queries))
                worst = np.zeros(len(queries), np.int64)
                np.maximum.at(worst, best[:, 0], best[:, 2])
                live = live[(found[live] < k) | (worst[live] > self.m * r + s)]
        return best[:, 0], best[:, 1], best[:, 2]

    def _trim(self, rows: np.ndarray, k: int, rank: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rank[rows[:, 1]], rows[:, 2], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])  # a code met in two segments
        rows = rows[new]
        first = np.concatenate(([0], np.nonzero(np.diff(rows[:, 0]))[0] + 1)) if len(rows) else np.empty(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.concatenate((first, [len(rows)]))))
        return rows[place < k]


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): one bit a dimension, set where the value is above zero, padded to whole segments.

    Rows with a null id or vector are left out; a null value gives an unset bit. Vectors
    of different lengths may give codes of different lengths.
    """
    bits = F.transform(F.col("v"), lambda x: F.when(x > 0, "1").otherwise("0"))
    whole = F.ceil(F.length("b") / SEGMENT) * SEGMENT
    hexed = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), (F.length(b) / 4).cast("int") - 1), lambda i: F.conv(F.substring(b, i * 4 + 1, F.lit(4)), 2, 16)), "")
    kept = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    joined = kept.select("id", F.array_join(bits, "").alias("b"))
    padded = joined.select("id", F.rpad("b", whole.cast("int"), F.lit("0")).alias("b"))
    return padded.select("id", F.unhex(hexed(F.col("b"))).alias("code"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, distance: the k nearest codes of every query, ties by smaller id.

    ``codes`` and ``queries`` have (id, code); a query is compared with the codes of
    its own length. A query that is also a code finds itself. Fewer than k codes give fewer rows; empty
    tables none. Repeated ids are separate rows.
    """
    n, q = codes.count(), queries.count()
    shards = max(1, math.ceil(n / SHARD_ROWS), min(24, math.ceil(n / 2048)))
    blocks = max(1, math.ceil(q / BLOCK_QUERIES))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = codes.select("id", "code", F.length("code").alias("size"), part("id", shards).alias("shard"), spread(blocks).alias("block"))
    right = queries.select(F.col("id").alias("qid"), F.col("code").alias("qcode"), F.length("code").alias("qsize"), spread(shards).alias("qshard"), part("id", blocks).alias("qblock"))
    # a number of partitions that is asked for is not merged, so the shards are searched side by side
    left, right = left.repartition(2 * shards * blocks, "shard", "block", "size"), right.repartition(2 * shards * blocks, "qshard", "qblock", "qsize")

    def search(_, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(wanted):
            ids, asked = rows["id"].to_numpy(), wanted["qid"].to_numpy()
            bytes_of = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
            index, sought = MultiIndex(bytes_of(rows["code"])), bytes_of(wanted["qcode"])
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            for at in range(0, len(sought), AT_ONCE):
                own, code, far = index.search(sought[at : at + AT_ONCE], k, rank)
                out.append(pd.DataFrame({"query_row": at + own, "query_id": asked[at + own], "id": ids[code], "distance": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "id": [], "distance": []})

    local = left.groupBy("shard", "block", "size").cogroup(right.groupBy("qshard", "qblock", "qsize")).applyInPandas(search, "query_row long, query_id long, id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def every_fiftieth(codes: DataFrame) -> DataFrame:
    return codes.where(F.col("id") % 50 == 0)


def search_embeddings(vectors: DataFrame, k: int = 10) -> DataFrame:
    codes = materialise(sign_codes(vectors), "codes")
    return top_k(codes, every_fiftieth(codes), k)

