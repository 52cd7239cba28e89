"""Connected components of an edge table, without collecting it anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step is a pre-aggregated
minimum per node and a join, so a node with very many neighbours is no single
task's work. Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: So few edges are one partition (1.6 MB): the driver keeps a thread for each shuffle of the last minute, and short rounds have very many.
ONE_PARTITION = 100_000


def _together(df: DataFrame, one: bool) -> DataFrame:
    return df.coalesce(1) if one else df


def _star(edges: DataFrame, large: bool, one: bool = False) -> DataFrame:
    """Reconnect the neighbours of each node to the smallest node among it and them.

    ``edges`` (u, v) holds u > v once. Large star: of a node's larger neighbours;
    small star: of its smaller neighbours and itself. ``one``: all in one partition, without a shuffle.
    """
    edges = _together(edges, one)
    if large:
        both = _together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), one)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # the larger neighbours of n: the edges stored as (u, n)
        moved = edges.join(least, edges["v"] == least["n"]).select(F.col("u"), F.col("m").alias("v"))
        out = moved
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        linked = edges.join(least, edges["u"] == least["n"])
        out = _together(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))), one)
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Self-links, repeated links and links with a null end are ignored; an empty
    edge table gives an empty result. Rounds grow with the logarithm of the
    largest component.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    e = materialise(e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    mark, n = None, e.count()
    while True:
        one = n <= ONE_PARTITION
        new = materialise(_star(_star(e, True, one), False, one), "edges")
        # a forest of stars is the only fixed point: compare a fingerprint of the edge set
        now = _together(new, one).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(e)
        e = new
        if tuple(now) == mark:
            break
        mark, n = tuple(now), now[0]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
