"""RESOLVE_ENTITIES: spellings of one thing to the most frequent one.

Distinct values, by falling frequency (ties: first seen), become leaders in turn;
a leader takes all values not taken yet whose sequence similarity to it is at
least the threshold. Only distinct values are compared.

Candidates share a rare pair of letters. A ratio of t means that at least t(la + lb)/2 letters match,
in at most (1 - t)(la + lb) + 1 runs, since two runs have an unmatched letter between them; so at least
(1.5t - 1)(la + lb) - 1 pairs of letters match too. Two values with so many common pairs share one of the
rarest pairs of either (its *prefix*), which is what they are joined on. Where that bound says
nothing (short values, low thresholds) single letters take the pairs' place.

The leader rule is sequential by definition. Whether a value is taken depends on the
similar values ahead of it alone, so it is decided in rounds; once few links are left, one task ends them.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..graph import keep
from .meeting import spread

DEFAULT = 0.85
#: Undecided links that one task may decide.
TASK_LINKS = 200_000
#: Pairs that one task makes, about; they are held in memory to be told apart. A gram of more than GRAM_ROWS values is dealt to a grid.
TASK_PAIRS, GRAM_ROWS, HOT_GRAMS = 500_000, 700, 100_000


def similarity():
    """The ratio of ``SequenceMatcher(None, other, leader)``; the order of arguments matters."""

    @F.pandas_udf(T.DoubleType())
    def ratio(leader: pd.Series, other: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=leader.index)
        for a, rows in leader.groupby(leader).groups.items():
            match = SequenceMatcher(None, "", a)  # what is known of the second text is kept for all others
            for i, b in other.loc[rows].items():
                match.set_seq1(b)
                out[i] = match.ratio()
        return out

    return ratio


def _prefixes(values: DataFrame, size: int, least: Column) -> DataFrame:
    """(id, n, len, gram): the rarest grams of each value, as many as must hold one of any ``least`` common ones.

    A gram that occurs again is another gram, so that common grams are counted as often as they occur.
    """
    n = F.col("len") - (size - 1)
    grams = values.where((n >= 1) & (least >= 1)).withColumn("keep", n - least + 1).where("keep >= 1")
    cells = grams.select("id", "n", "len", "keep", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("value"), i, F.lit(size)))).alias("text"))
    counted = cells.groupBy("id", "n", "len", "keep", "text").agg(F.count("*").alias("times"))
    each = counted.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("id", "n", "len", "keep", F.struct("text", "time").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = each.join(common, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")))
    return ranked.where("rank <= keep").select("id", "n", "len", "gram")


def _ahead() -> Column:
    return (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))


def _length(threshold: float) -> Column:
    return 2 * F.least("la", "lb") >= threshold * (F.col("la") + F.col("lb"))


def _letters(value: str) -> Column:
    """The letters of a value, those that occur again told apart, so that common letters are an intersection."""
    letters = F.array_sort(F.split(F.col(value), ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def _met(grams: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the values that share a gram, once for each shared one."""
    sides = (grams.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("len").alias(f"l{x}"), "gram") for x in "ab")
    a, b, by = spread(*sides, ["gram"], GRAM_ROWS, TASK_PAIRS, HOT_GRAMS)
    return a.join(b, by).where(_ahead() & _length(threshold)).select("a", "b")


def candidates(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b): ids of values (id, value, len, n) that can be similar, a ahead of b."""
    shortest = F.ceil(F.col("len") * (threshold / (2 - threshold)))
    pair = 1.5 * threshold - 1
    limit = 2 / pair if pair > 1e-9 else inf  # lengths together from which pairs of letters are shared
    letters = F.ceil((F.col("len") + shortest) * (threshold / 2) - 1e-9)
    families = []
    if limit < inf:
        partner = F.greatest(shortest, F.ceil(F.lit(limit)) - F.col("len"))
        families.append(("pairs", _prefixes(values, 2, F.ceil((F.col("len") + partner) * pair - 1 - 1e-9))))
    families.append(("letters", _prefixes(values if limit == inf else values.where(F.col("len") + shortest < limit + 1), 1, letters)))
    found = None
    for _, grams in families:
        met = _met(keep(grams), threshold)
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def leaders(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, fa, nb, fb): similar values of (value, n, first), a ahead of b."""
    known = values.select("value", F.length("value").alias("len"), "n", F.col("first").alias("id"))
    pairs = candidates(known.where("len > 0"), threshold)
    side = lambda x: known.select(F.col("id").alias(x), F.col("value").alias(f"{x}_value"), F.col("len").alias(f"l{x}"), F.col("n").alias(f"n{x}"), _letters("value").alias(f"{x}_letters"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(2 * F.size(F.array_intersect("a_letters", "b_letters")) >= threshold * (F.col("la") + F.col("lb")) - 1e-9)
    near = pairs.withColumn("ratio", similarity()("a_value", "b_value")).where(F.col("ratio") >= threshold)
    return near.select(F.col("a_value").alias("a"), F.col("b_value").alias("b"), "na", F.col("a").alias("fa"), "nb", F.col("b").alias("fb"))


def assign(near: list[tuple], rank: dict[str, tuple]) -> dict[str, str]:
    """The leader rule over similar pairs (a ahead of b)."""
    follows: dict[str, list[str]] = {}
    for a, b in near:
        follows.setdefault(a, []).append(b)
    taken: dict[str, str] = {}
    for a in sorted(rank, key=rank.__getitem__):
        if a in taken:
            continue
        taken[a] = a
        for b in follows.get(a, ()):
            taken.setdefault(b, a)
    return {b: a for b, a in taken.items() if a != b}


def taken_values(near: DataFrame, most: int = TASK_LINKS) -> DataFrame:
    """(b): values that some leader takes.

    A value that none ahead of it can take leads, and takes all it is linked to; both are
    then decided. Rounds go on until no link between undecided values is left.
    """

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = {r.a: (-r.na, r.fa) for r in pdf.itertuples()} | {r.b: (-r.nb, r.fb) for r in pdf.itertuples()}
        return pd.DataFrame({"b": list(assign(list(zip(pdf["a"], pdf["b"], strict=True)), rank))}, columns=["b"])

    left, taken = near, None
    while True:
        if left.count() <= most:  # counted, so one task can hold them
            rest = left.groupBy(F.lit(1).alias("one")).applyInPandas(rule, "b string")
            return rest if taken is None else taken.unionByName(rest)
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = keep(left.join(heads, "a", "left_semi").select("b").distinct())
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(F.col("b").alias("x")).unionByName(heads.select(F.col("a").alias("x")))
        left = keep(left.join(gone, F.col("a") == F.col("x"), "left_anti").join(now, "b", "left_anti"))


def resolve_entities(args, opts, ctx):
    """Values replaced by their leaders; nulls stay."""
    series = args[0]
    rel, name = series.relation, series.name
    rid = ctx.row_ids(rel)
    values = rel.df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(rid).alias("first"))
    near = ctx.keep(leaders(ctx.keep(values), float(opts.get("similarity_threshold", DEFAULT))))
    taken = ctx.keep(taken_values(near))
    leading = near.join(taken.select(F.col("b").alias("a")), "a", "left_anti")
    table = ctx.keep(leading.groupBy(F.col("b").alias("value")).agg(F.min_by("a", F.struct(-F.col("na"), "fa")).alias("leader")))
    return ctx.mapped(series, table)
