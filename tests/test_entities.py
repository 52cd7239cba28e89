"""RESOLVE_ENTITIES against the rule applied value by value."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.operators import entity
from weftline.queries import col, node, run

WORDS = ["acme trading", "acme tradng", "globex", "globx", "initech corp", "initech corp.", "umbrella holdings ltd", "umbrela holding ltd", "stark", "strak", "ab", "ba", "a", "aaaa", "aaa", "", "müller gmbh", "muller gmbh", "xyz 12", "xyz 21"]


def names(r, n):
    out = []
    for _ in range(n):
        w = r.choice(WORDS)
        if w and r.random() < 0.5:
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcxyz ") + w[i:], w.upper(), w[::-1], w + w])
        out.append(None if r.random() < 0.05 else w)
    return out


def plain(values, t):
    counts, first = Counter(v for v in values if v is not None), {}
    for i, v in enumerate(values):
        if v is not None:
            first.setdefault(v, i)
    order = sorted(counts, key=lambda v: (-counts[v], first[v]))
    leader = {}
    for i, a in enumerate(order):
        if a in leader:
            continue
        leader[a] = a
        for b in order[i + 1 :]:
            if b not in leader and a and b and SequenceMatcher(None, b, a).ratio() >= t:
                leader[b] = a
    return [None if v is None else leader[v] for v in values]


def resolved(spark, values, t):
    df = spark.createDataFrame(list(enumerate(values)), "id long, value string").repartition(3)
    out = run(df, {"id": node("COPY", col("id")), "v": node("RESOLVE_ENTITIES", col("value"), similarity_threshold=t)}, row_id="id")
    return [r.v for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("t", [0.5, 0.7, 0.85, 0.95])
def test_against_the_rule(spark, t):
    values = names(random.Random(int(t * 100)), 160)
    assert resolved(spark, values, t) == plain(values, t)


@pytest.mark.parametrize("t", [0.6, 0.75, 0.85, 0.9])
def test_no_similar_pair_is_missed(spark, t):
    r = random.Random(5)
    texts = sorted({"".join(r.choice("abcd ") for _ in range(r.randint(1, 14))) for _ in range(150)} | {v for v in names(r, 100) if v})
    values = spark.createDataFrame([(i, v, len(v), 1) for i, v in enumerate(texts)], "id long, value string, len int, n long")
    found = {(p.a, p.b) for p in entity.candidates(values, t).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and SequenceMatcher(None, b, a).ratio() >= t}
    assert want <= found and len(found) < len(texts) ** 2 / (4 if t > 0.8 else 2)


def test_no_task_makes_very_many_pairs(spark, monkeypatch):
    """Pairs of a gram that many values share, and of many small grams, are made by as many tasks as they fill."""
    monkeypatch.setattr(entity, "TASK_PAIRS", 500)
    monkeypatch.setattr(entity, "GRAM_ROWS", 20)
    rows = [(i, 1, 6, ("x" if i < 120 else f"y{i % 40}", 1)) for i in range(400)]
    met = entity._met(spark.createDataFrame(rows, "id long, n long, len int, gram struct<text:string,time:int>"), 0.85)
    got = met.select("a", "b", F.spark_partition_id().alias("task")).collect()
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if rows[i][3] == rows[j][3]}
    assert len(got) == len(want) and {(p.a, p.b) for p in got} == want
    assert max(Counter(p.task for p in got).values()) < len(want) / 4


def test_rounds_decide_as_one_task_does(spark):
    r = random.Random(3)
    ranks = {f"v{i}": (r.randint(1, 5), i) for i in range(80)}
    order = sorted(ranks, key=lambda v: (-ranks[v][0], ranks[v][1]))
    links = {(order[i], order[j]) for i, j in (sorted(r.sample(range(80), 2)) for _ in range(160))} | {(order[i], order[i + 1]) for i in range(12)}
    near = spark.createDataFrame([(a, b, ranks[a][0], ranks[a][1], ranks[b][0], ranks[b][1]) for a, b in links], "a string, b string, na long, fa long, nb long, fb long")
    want = set(entity.assign(sorted(links), {v: (-n, f) for v, (n, f) in ranks.items()}))
    for most in (0, 20, 10_000):
        assert {x.b for x in entity.taken_values(near, most).collect()} == want


def test_empty_and_null(spark):
    assert resolved(spark, [None, None], 0.85) == [None, None]
    assert resolved(spark, [""], 0.85) == [""]
    df = spark.createDataFrame([], "id long, value string")
    assert run(df, {"v": node("RESOLVE_ENTITIES", col("value"))}, row_id="id").count() == 0
