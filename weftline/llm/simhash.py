"""SimHash near-duplicate search by the generalised pigeonhole principle.

1. Fingerprints: per text, the majority bits of the XXH64 hashes of its word
   shingles (Arrow batches, numpy bit votes; texts never shuffle). Equal
   fingerprints collapse to one row before anything is joined.
2. Plan: the 64 bits go to ``m`` partitions. Bits that are correlated are put
   into the same partition, so that partitions differ from each other; a
   partition of threshold t is probed with every value that differs in at most t
   bits. For a distance of ``radius`` the thresholds must sum to
   ``radius - m + 1`` (a partition with threshold -1 is not probed). For each
   ``m``, dynamic programming picks the thresholds with the least estimated
   cost, from counts of equal and near partition values over all fingerprints;
   the cheapest ``m`` is used.
3. Probe and verify: postings and probes meet in an equi-join by (partition,
   value) and the full distance decides.

Buckets that hold more than ``PAIR_BUCKET`` fingerprints are not paired. There
the same links are found through midpoints: two fingerprints differ in at most
two bits exactly if some value lies within one bit of both, so each member of
such a bucket is written under itself and its neighbours at one bit, and members
that meet are linked to the smallest. That is linear in the bucket, drops
nothing, and gives the same components. (For other radii the midpoint rule is
applied with half the radius, rounded up, followed by verification: see
``_midpoint_links``.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, materialise
from .components import components

BITS = 64
PAIR_BUCKET = 24
SEED = 42


def fingerprint(text: str, size: int = 3) -> int:
    """Of one text: A-Z lower-cased, words joined by single spaces, ``size``-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - size + 1
        spans = zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    return vote(hashes)


def vote(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long. A null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# ---- the plan -------------------------------------------------------------


def bit_groups(corr: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to ``m`` partitions of near-equal width, correlated bits together.

    Greedy: a partition starts with the free bit that has the strongest ties and
    takes the free bit most correlated with its members until it is full.
    """
    free, out = set(range(BITS)), []
    strength = np.abs(corr)
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def pick(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint, as a compact number."""
    out = np.zeros(len(values), np.uint64)
    for to, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def _pick_column(fp, bits: list[int]):
    """The same as a column: runs of neighbouring bits move together."""
    parts, to = [], 0
    while to < len(bits):
        run = 1
        while to + run < len(bits) and bits[to + run] == bits[to] + run:
            run += 1
        mask = (1 << run) - 1
        piece = F.shiftrightunsigned(fp, bits[to]).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
        parts.append(F.shiftleft(piece, to))
        to += run
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in some) for r in range(most + 1) for some in combinations(range(width), r)]


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that sum to ``total``; ``cost[i][t + 1]`` is partition i's at threshold t.

    Dynamic programming over partitions and the sum of their thresholds.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (c, ts) in best.items():
            for k, own in enumerate(row):
                t = k - 1
                if (s := done + t) not in step or c + own < step[s][0]:
                    step[s] = (c + own, [*ts, t])
        best = step
    return best.get(total, (math.inf, []))


def make_plan(fps: DataFrame, radius: int, n: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the probed partitions.

    Bit correlations and the collision rates of partition values come from
    counts over all distinct fingerprints: 64 + 2016 sums, and, per candidate
    partition, the sum of squared value counts.
    """
    if n < 2:
        return [(list(range(BITS)), 0)] if radius == 0 else [(list(range(32)), (radius + 1) // 2), (list(range(32, 64)), max(radius - 1 - (radius + 1) // 2, 0))]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, count = np.zeros((BITS, BITS)), 0
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            if len(v):
                bits = np.unpackbits(np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                gram += bits.T @ bits
                count += len(v)
        if count:
            yield pa.record_batch([pa.array(np.arange(BITS * BITS)), pa.array(gram.ravel())], names=["cell", "s"])

    cells = fps.select("fp").mapInArrow(moments, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()  # BITS x BITS rows
    gram = np.zeros(BITS * BITS)
    gram[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    gram = gram.reshape(BITS, BITS)
    p = np.diag(gram) / n
    cov = gram / n - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    best: tuple[float, list] = (math.inf, [])
    dealt = {m: bit_groups(corr, m) for m in range(2, min(radius + 2, 8) + 1)}
    # all partitions of all plans in one pass: fingerprints that share a value, summed per partition
    values = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), _pick_column(F.col("fp"), g).alias("value")) for m, groups in dealt.items() for i, g in enumerate(groups)))
    same = fps.select(F.explode(values).alias("v")).groupBy("v.m", "v.part", "v.value").count()
    equal = {(r["m"], r["part"]): float(r["s"]) for r in same.groupBy("m", "part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("s")).collect()}
    for m, groups in dealt.items():
        cost = []
        for i, g in enumerate(groups):
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(math.comb(len(g), r) for r in range(t + 1))
                # a probe costs a row; a candidate pair costs a row too, and near values are about as often met as equal ones
                row.append(n * (1 + probes) + equal.get((m, i), 0.0) + (probes - 1) * n * (n / 2 ** len(g)))
            cost.append(row)
        total, ts = allocate(cost, radius - m + 1)
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


# ---- probe and verify -------------------------------------------------------


def _midpoint_links(members: DataFrame, bits: list[int], radius: int) -> DataFrame:
    """Links (u, v) of large buckets through values within half the radius of both ends.

    Within a bucket of equal partition bits only the other bits are flipped. A
    meeting value is within ``ceil(radius / 2)`` of both ends. For an even radius
    every two that meet are within the radius, so all are linked to the least;
    an odd radius is answered with the next even one's ball on one side only.
    """
    other = [b for b in range(BITS) if b not in set(bits)]
    near, far = radius // 2, radius - radius // 2
    mask = lambda most: [sum(1 << other[k] for k in some) for r in range(most + 1) for some in combinations(range(len(other)), r)]
    signed = lambda ms: F.array(*(F.lit(x - (1 << 64) if x >= 1 << 63 else x) for x in ms))
    ball = lambda most: members.select("fp", "part", "value", F.explode(signed(mask(most))).alias("x")).select("fp", "part", "value", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"))
    small = ball(near)
    if near == far:
        least = small.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w")
        return small.join(least, "mid").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    wide = ball(far).select(F.col("fp").alias("v"), "mid")
    return small.join(wide, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all those within ``radius`` bits.

    ``fps`` has distinct values in ``fp``. Small buckets give every link; large
    ones give links with the same connectivity (see the module's text).
    """
    n = fps.count()
    plan = make_plan(fps, radius, n)
    out = []
    for k, (bits, t) in enumerate(plan):
        keyed = fps.select("fp", F.lit(k).alias("part"), _pick_column(F.col("fp"), bits).alias("value"))
        sizes = keyed.groupBy("value").count().where(F.col("count") > PAIR_BUCKET).select("value")
        sizes = materialise(sizes, "large-buckets")
        large = keyed.join(sizes, "value", "left_semi")
        small = keyed.join(sizes, "value", "left_anti")
        probes = keyed if t else small
        if t:
            masks = F.array(*(F.lit(x) for x in flips(len(bits), t)[1:]))
            probes = small.unionByName(keyed.select("fp", "part", F.explode(masks).alias("x"), "value").select("fp", "part", F.col("value").bitwiseXOR(F.col("x")).alias("value")))
        post = small.select(F.col("fp").alias("v"), "value")
        met = probes.join(post, "value").where((F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius))
        out.append(met.select(F.col("fp").alias("u"), "v"))
        if sizes.limit(1).count():
            out.append(_midpoint_links(large, bits, radius))
            if t:  # a probe that meets a large bucket from outside: the midpoint rule over all bits of the probe's side
                hits = probes.where(F.col("part") == k).join(sizes, "value", "left_semi").select("fp").distinct()
                out.append(_midpoint_links(hits.unionByName(large.select("fp")).distinct().select("fp", F.lit(k).alias("part"), F.lit(0).cast("long").alias("value")), [], radius))
    return reduce(DataFrame.unionByName, out)


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable) of every document.

    Two documents are linked if their fingerprints differ in at most ``radius``
    bits. Null and blank texts have fingerprint zero and are linked like others.
    A null id keeps its row and never names a component unless all ids of it are
    null. Repeated rows stay. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "fingerprint-nodes")
    comp = components(links(nodes.select("fp"), radius))
    named = materialise(nodes.join(comp, nodes["fp"] == comp["node"], "left").select(nodes["fp"], "first", F.coalesce("component", nodes["fp"]).alias("component")), "fingerprint-names")
    # written first, so that a very large component's side of the join can be split
    least = materialise(named.groupBy("component").agg(F.min("first").alias("component_id")), "fingerprint-components")
    by_fp = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
