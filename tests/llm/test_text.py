import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lm, pii, topk
from weftline.llm.lm import HashIndex, score_documents
from weftline.llm.pii import KINDS, expectation_maximisation, redact, span_digests
from weftline.llm.quality import MIN_GROUP, keep_good, quality_rules
from weftline.llm.topk import MultiIndex, every_fiftieth, search_embeddings, sign_codes, top_k

GAP = re.compile(r"[\x20\x09-\x0D]+")


# ---- quality rules ---------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {p for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(docs, texts, empty, odd_ids):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0
    assert [r.kept for r in quality_rules(odd_ids).collect()] == [False] * 4


def test_fences_reject_junk_and_keep_clean_documents(spark):
    r = random.Random(3)
    rows = []
    for i in range(2 * MIN_GROUP + 60):
        words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(120)]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "big" if i < 2 * MIN_GROUP else "small"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.kept for x in quality_rules(df).collect()}
    assert got == {i: i % 20 != 0 for i in got}
    assert {x.doc_id for x in keep_good(df).collect()} == {i for i, k in got.items() if k}


def test_keep_good_keeps_all_columns(docs, empty):
    out = keep_good(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert keep_good(empty).count() == 0


# ---- personal data ---------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans(spark, docs, texts, empty, odd_ids):
    r = random.Random(5)
    chars = "0123456789012345678901234567890123456789.... -+()@@@abz_é😀\n%"
    odd = ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    odd += ["a" * 50_000, "1 " * 30_000, "1" * 50_000, "a@b.c" * 3000, "a@b.c_x@d.e", "@" * 999, None, ""] + texts
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in span_digests(df).collect()}
    for i, t in enumerate(odd):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in want) for k in KINDS]
        assert set(want) <= set(got[i].spans.split(",")) or not want
    assert span_digests(empty).count() == 0 and span_digests(odd_ids).count() == 4


def test_context_adds_spans_and_decoys_stay_out(spark):
    r = random.Random(1)
    rows = [(i, f"please call me on ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)} today" if i % 2 else f"write to a.b{i} [at] mail{i} [dot] com soon") for i in range(200)]
    rows += [(1000 + i, f"order {r.randint(10**15, 10**16 - 1)} shipped") for i in range(200)]
    got = {x.doc_id: x.spans for x in span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = sum(bool(got[i]) for i in range(200))
    assert added > 150
    assert all(got[i] == ",".join(base_spans(t)) for i, t in rows if i >= 1000)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é x@y.com or +1 (743) 555-3824.", "k"), (2, None, "k"), (3, "", "k"), (4, "none here", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in redact(df).collect()}
    assert got[1].text == "mail é <EMAIL> or <PHONE>." and got[1].spans == "k"
    assert got[2].text is None and got[3].text == "" and got[4].text == "none here"


def test_expectation_maximisation_finds_the_reliable_labeler():
    r = random.Random(2)
    counts = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        vote = lambda right, y=y: "1" if (r.random() < right) == y else "0"
        counts["card", vote(0.95) + vote(0.9) + vote(0.55)] += 1
    p = expectation_maximisation([(k, v, n) for (k, v), n in counts.items()])
    assert p["card", "110"] > 0.8 and p["card", "001"] < 0.2


# ---- language-model scores ---------------------------------------------------------


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_base_scores(docs, texts, head, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_HEAD", head)
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    words = {i: [*(t or "").encode().lower().split(), b"\xff"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        assert got[i].held_out == held[i] and got[i].n_tokens == len(ws) and got[i].train_tokens == n
        assert got[i].n_known == sum(count[w] > 0 for w in ws)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0


def test_the_model_predicts_held_out_text_better(spark):
    r = random.Random(8)
    after = {w: r.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(300):
        w, out = r.randrange(40), []
        for _ in range(80):
            out.append(f"w{w}")
            w = r.choice(after[w])
        rows.append((i, " ".join(out)))
    got = [x for x in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) + 0.1 * sum(x.n_tokens for x in got)


def test_scores_do_not_depend_on_partitions(spark, docs):
    a, b = ({r.doc_id: r.score for r in score_documents(docs.repartition(n)).collect()} for n in (1, 6))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-5) for i in a)


def test_words_of_a_class_share_its_probability():
    counts, classes = np.array([50, 9, 9, 7, 3, 2, 1, 1] * 40), np.array([0, 1] * 160)
    classes[:3] = 2
    trees = lm.Trees(classes, counts, 10_000)
    weights = np.random.default_rng(1).normal(0, 1, (2, trees.rows, lm.BRANCH)).astype(np.float32)
    ids, one, two = np.arange(len(counts)), np.full(len(counts), 5), np.full(len(counts), 9)
    logp = np.zeros(len(counts))
    for at, node, child, a, b in trees.steps(ids, one, two):
        z = trees.logits(weights, node, a, b).astype(float)
        logp[at] += z[np.arange(len(z)), child] - np.log(np.exp(z).sum(axis=1))
    for c in range(3):
        assert abs(np.exp(logp[classes == c]).sum() - 1) < 1e-4


def test_scores_edge_cases(empty, odd_ids):
    assert score_documents(empty).count() == 0
    assert sorted(r.n_tokens for r in score_documents(odd_ids).collect()) == [1, 5, 5, 5]


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) == -1).all()
    assert (HashIndex(np.empty(0, np.uint64)).find(keys) == -1).all()


# ---- top-k -------------------------------------------------------------------------


@pytest.mark.parametrize("bits, width", [(64, 8), (32, 4)])
def test_multi_index_against_all_distances(bits, width):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, width)).astype(np.uint8)
    codes[100:200] = codes[0]  # a hot code
    codes[200:260] = codes[1] ^ 1
    queries = codes[::25]
    rank = rng.permutation(len(codes))
    for k in (1, 10, 600):
        q, c, d = MultiIndex(codes).search(queries, k, rank)
        for i in range(len(queries)):
            far = np.bitwise_count(codes ^ queries[i]).sum(axis=1)
            want = np.lexsort((rank, far))[:k]
            assert set(c[q == i]) == set(want) and sorted(d[q == i]) == sorted(far[want])


def test_search_embeddings(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=40)], i) for i in range(300)] + [(None, [1.0] * 40, 0), (9999, None, 0), (50, [1.0] * 40, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes = {(r.id, bytes(r.code)) for r in sign_codes(df).collect()}
    table = [(i, np.frombuffer(c, np.uint8)) for i, c in sorted(codes)]
    got = {}
    for r in search_embeddings(df, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q in (0, 100, 250):
        code = dict(table)[q]
        want = sorted((int(np.bitwise_count(c ^ code).sum()), i) for i, c in table)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    none = df.where(F.lit(False))
    assert search_embeddings(none).count() == 0
    c = sign_codes(df)
    assert top_k(c, every_fiftieth(c).where("id = 100"), 1).collect()[0].id == 100


def test_texts_of_very_many_matches(spark):
    """Positions, added spans and redaction in time that grows with the text only."""
    import time

    r = random.Random(4)
    parts = [r.choice([f"mail u{i}@host{i}.org", f"ip 10.{i % 256}.2.3", "call 212-555-0199", f"née {i}", "write to a [at] b.com"]) for i in range(20_000)]
    text = " ".join(parts)
    began = time.time()
    df = spark.createDataFrame([(1, text), (2, "née a@b.org x")], "doc_id long, text string")
    got = {x.doc_id: x for x in span_digests(df).collect()}
    want = base_spans(text)
    assert got[1].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(got[1].spans.split(","))
    clean = {x.doc_id: x.text for x in redact(df).collect()}
    assert clean[2] == "née <EMAIL> x" and "@host" not in clean[1] and clean[1].count("<EMAIL>") >= sum(p.startswith("mail") for p in parts)
    assert clean[1].count("née") == sum(p.startswith("née") for p in parts)
    assert time.time() - began < 60


def test_shards_are_searched_side_by_side(spark):
    rows = [(i, [math.sin(i * j + j) for j in range(1, 33)]) for i in range(20_000)]
    out = search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    busy = out.select("query_id").distinct().count()
    assert busy == 400 and "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(i, "plain words of a text " * 20 + str(i), "en", "s", i, i, i) for i in range(3)], "doc_id long, text string, lang string, source string, __q int, q int, row int")
    assert keep_good(df).columns == df.columns


def test_vectors_of_different_lengths_are_searched_apart(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(64 if i % 3 else 128)]) for i in range(120)]
    codes = sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for x in top_k(codes, every_fiftieth(codes), 4).collect():
        got.setdefault(x.query_id, []).append((x.distance, x.id))
    bits = {i: [v > 0 for v in vs] for i, vs in rows}
    for q in (0, 50, 100):
        near = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if len(bits[i]) == len(bits[q]))
        assert sorted(got[q]) == near[:4]


def test_added_spans_are_found_within_the_row(spark):
    """No text is shuffled to meet the spans added to it, and added ones keep clear of base ones, also among very many."""
    r = random.Random(11)
    spans = []
    for _ in range(30):
        row = []
        for _ in range(r.randint(0, 200)):
            start = r.randint(0, 900)
            row.append((start, start + r.randint(1, 12), "email", r.random() < 0.3, "1111", ["rule=1"]))
        spans.append(row)
    found = spark.createDataFrame([(i, (f"t{i}",), s) for i, s in enumerate(spans)], f"rid long, row struct<text:string>, found {pii._SPAN_ARRAY}").repartition(3)
    weights = {("email", ""): 9.0}
    out = pii.decided(found, weights)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    for x in out.collect():
        row = spans[int(x.row.text[1:])]
        base = [s for s in row if s[3]]
        clear = [s for s in row if s[3] or (all(b[1] <= s[0] for b in base if b[0] < s[0]) and all(b[0] >= s[1] for b in base if b[0] >= s[0]))]
        assert sorted((s.start, s.end) for s in x.spans) == sorted((s[0], s[1]) for s in clear)
        assert sorted((s.start, s.end) for s in x.base) == sorted((s[0], s[1]) for s in base)
