import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import components as components_module
from weftline.llm import lines as line_module
from weftline.llm import simhash
from weftline.llm.components import components
from weftline.llm.lines import dedup_lines, sketched
from weftline.llm.neardup import drop_near_duplicates, near_duplicate_groups
from weftline.llm.passages import compact_windows, duplicate_passages, shingle_hashes, words_of
from weftline.llm.simhash import allocate, fingerprint, simhash_components


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 340)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = roots(400, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, size):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_rounds_of_few_edges_need_no_shuffle(spark, monkeypatch):
    """The driver keeps a thread a shuffle for a minute; results are the same with shuffles."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60) if i % 7] + [(100, 3), (200, 100)], "u long, v long")
    written = components_module.materialise(edges, "edges")
    star = components_module._star(components_module._star(written, True, True), False, True)
    assert "Exchange hashpartitioning" not in star._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(components_module, "ONE_PARTITION", -1)
    assert sorted(map(tuple, components(edges).collect())) == few and len(few) == 62


def test_fingerprints(texts, spark):
    for t in texts:
        assert fingerprint(t or "", 3) == plain_fingerprint(t or "", 3)
    assert spark.sql("SELECT xxhash64('ab c') x").first().x % 2**64 == xxhash.xxh64_intdigest(b"ab c", 42)


def test_thresholds_by_dynamic_programming():
    cost = [[0, 5, 9], [0, 1, 2], [0, 4, 20]]
    want = min(sum(c[t] for c, t in zip(cost, ts, strict=True)) for ts in np.ndindex(3, 3, 3) if sum(ts) - 3 == 0)
    assert allocate(cost, 0)[0] == want


@pytest.mark.parametrize("bucket", [0, 24])
def test_simhash_components_against_all_pairs(spark, bucket, monkeypatch):
    """Fingerprints that cluster; with bucket 0 all links come from midpoints."""
    monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
    r = random.Random(5)
    fps = []
    for _ in range(12):
        base = r.getrandbits(64)
        fps += [base] + [base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(12)]
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    place = {x: i for i, x in enumerate(signed)}
    got = roots(len(fps), [(place[x.u], place[x.v]) for x in links])
    want = roots(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == want


def test_simhash_components_of_documents(docs, texts, empty, odd_ids):
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    fps = [plain_fingerprint(t or "", 3) for t in texts]
    want = roots(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", want[i]) for i, f in enumerate(fps)}
    assert simhash_components(empty).count() == 0
    assert sorted(str(r.component_id) for r in simhash_components(odd_ids).collect()) == ["5", "5", "5", "None"]


def test_near_duplicates_are_dropped_once(docs, texts):
    """Against five-word shingles alone."""
    kept = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    sets = [set(shingle_hashes(words_of(t or ""), min(5, max(1, len(words_of(t or ""))))).tolist()) for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = roots(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8])
    assert kept == {i for i, w in enumerate(want) if i == w}
    assert 0 in kept and not {60, 61} & kept


def test_near_duplicate_recall(spark):
    """Of pairs of similarity 0.8 to 0.95 without any fingerprint; texts that are not similar stay."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprst") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    texts = []
    while len(texts) < 400:
        a = [vocabulary[min(int(r.paretovariate(0.7)), 3999)] for _ in range(r.randint(80, 600))]
        b = list(a)
        for _ in range(r.randint(1, max(1, len(a) // 40))):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        x, y = (set(shingle_hashes(words_of(" ".join(w))).tolist()) for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.95:
            texts += [" ".join(a), " ".join(b)]
    kept = {x.doc_id for x in drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i for i in range(0, 400, 2)} <= kept
    found = sum(i not in kept for i in range(1, 400, 2)) / 200
    print(found)
    assert found >= 0.9


def test_texts_of_one_fingerprint_that_differ(spark):
    """The same words in other orders: only those similar to one another meet, whatever the least of them is."""
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    a, b, c = (r.sample(base, 60) for _ in range(3))
    swapped = lambda w: [*w[:57], w[58], w[57], w[59]]
    rows = [" ".join(x) for x in (base, a, b, swapped(a), c, swapped(b))]
    kept = drop_near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in kept) == [0, 1, 2, 4]


def test_near_duplicate_edge_cases(empty, odd_ids):
    assert drop_near_duplicates(empty).count() == 0
    out = drop_near_duplicates(odd_ids)
    assert out.columns == odd_ids.columns and out.count() == 3


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (3, 46, 60, 300):
        for kind in (50, 2**60):
            for _ in range(10):
                g = rng.integers(0, kind, n).astype(np.uint64)
                want = []
                for i in range(n):
                    a = b = i
                    while a > 0 and g[a - 1] > g[i]:
                        a -= 1
                    while b < n - 1 and g[b + 1] >= g[i]:
                        b += 1
                    if b - a + 1 >= 46:
                        want.append((a, i, b))
                assert list(zip(*(x.tolist() for x in compact_windows(g, 46)), strict=True)) == want


def test_shingle_hashes_depend_on_the_words_only():
    a, b = words_of("Zero one two three four five six"), words_of("x y one  two\nTHREE four five six")
    assert shingle_hashes(a)[1:].tolist() == shingle_hashes(b)[2:].tolist()


def test_passages(docs, texts, empty, odd_ids):
    rows = duplicate_passages(docs).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50
    seen, hits = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if key in seen and seen[key][0] != i:
                hits |= {(i, k), seen[key]}
            seen.setdefault(key, (i, k))
    missed = [h for h in hits if not any(a <= h[1] and h[1] + 50 <= b for a, b in spans.get(h[0], ()))]
    assert not missed, missed
    assert {64, 65, 66, 67} <= set(spans) and 5 not in spans
    classes = {r.doc_id: r.class_id for r in rows if r.doc_id in (64, 65, 66, 67)}
    assert set(classes.values()) == {64} and sum(r.kept for r in rows if r.doc_id in classes) == 1
    assert duplicate_passages(empty).count() == 0 and duplicate_passages(odd_ids).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def normal(line):
    return "".join(c if c.isalpha() else " " for c in line.lower()).split()


def line_features(words):
    """By family, as the operator's text states them."""
    text, long = " ".join(words), [w for w in words if len(w) >= 6]
    out = {}
    if len(text) >= 48 and len(long) >= 4:
        out[0] = long
    if len(text) <= 60 or len(long) < 6:
        out[1] = [text[i : i + 3] for i in range(len(text) - 2)] if len(text) > 3 else [text]
    return out


def line_fp(features):
    votes = [0] * 64
    for w in features:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(features))


def similar_lines(a, b):
    """Without any fingerprint."""
    x, y = " ".join(a), " ".join(b)
    if min(len(x), len(y)) > 400:
        x, y = a, b
    longest = max(len(x), len(y))
    return abs(len(x) - len(y)) <= longest * 0.2 + 1e-9 and edit(x, y) <= int(longest * 0.2 + 1e-9)


def kept_by(texts, find):
    """Kept lines of every document: one of each group; ``find`` gives the group of each distinct normal form."""
    where, forms = [], {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            if w := normal(line):
                where.append((i, k, forms.setdefault(tuple(w), len(forms))))
    group = find(list(forms))
    first = {}
    for i, k, f in where:
        first.setdefault(group[f], (i, k))
    gone = {(i, k) for i, k, f in where if first[group[f]] != (i, k)}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None for i, t in enumerate(texts)]


def brute_groups(words):
    return roots(len(words), [(i, j) for i, j in combinations(range(len(words)), 2) if similar_lines(words[i], words[j])])


@pytest.mark.parametrize("chunk", [5, 126])
def test_line_fingerprints(spark, chunk, monkeypatch):
    """Of both families, also of lines longer than a chunk; blocks do not depend on the chunks."""
    monkeypatch.setattr(line_module, "CHUNK", chunk)
    r = random.Random(4)
    lines = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(4, 9))) for _ in range(n)) for n in (1, 2, 3, 6, 7, 8, 9, 40, 200)] + ["a", "ab c", "中文" * 90]
    df = spark.createDataFrame([(i, 0, i, 0, t) for i, t in enumerate(lines)], "rid long, part int, doc_id long, pos int, norm string")
    rows = sketched(df, (2, 6))[0].collect()
    assert {(r.rid, r.family): r.fp % 2**64 for r in rows} == {(i, f): line_fp(x) for i, t in enumerate(lines) for f, x in line_features(t.split()).items()}
    assert sorted(r.rid for r in rows if r.main) == list(range(len(lines)))
    for r in rows:
        tops = [xxhash.xxh64_intdigest(w.encode(), 42) >> 33 for w in line_features(lines[r.rid].split())[r.family]]
        blocks = [min(t ^ c for t in tops) for c in line_module._points(12)]
        want = [(r.family, blocks[t], blocks[t + 6]) for t in range(6)]
        test_line_fingerprints.keys.setdefault(tuple(want), [r[f"k{t}"] for t in range(6)])
        assert test_line_fingerprints.keys[tuple(want)] == [r[f"k{t}"] for t in range(6)]


test_line_fingerprints.keys = {}


def changed_lines(r, n, changes, kind):
    """A line of ``n`` words and a copy with so many words replaced, mistyped, left out or put in."""
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.choice((2, 3, 4, 5, 6, 7, 8, 9, 10)))) for _ in range(400)]
    a = [r.choice(vocabulary) for _ in range(n)]
    b = list(a)
    for k in r.sample(range(n), changes):
        if kind == "word":
            b[k] = r.choice(vocabulary)
        else:
            x = list(b[k])
            x[r.randrange(len(x))] = r.choice("xyzqö")
            b[k] = "".join(x)
    if kind == "moved":
        del b[r.randrange(len(b))]
        b.insert(r.randrange(len(b)), r.choice(vocabulary))
    return a, b


@pytest.mark.parametrize("plan", [0, 1])
def test_similar_lines_are_found(spark, plan, monkeypatch):
    """Recall against edit similarity alone, by length, with the keys for few and for many lines."""
    monkeypatch.setattr(line_module, "PLANS", ((1 << 62, *line_module.PLANS[plan][1:]),))
    r = random.Random(plan)
    pairs = {}
    for n, most in ((5, 1), (10, 2), (20, 4), (40, 8), (80, 16)):
        while sum(k[0] == n for k in pairs) < 120:
            a, b = changed_lines(r, n, r.randint(1, most), r.choice(("word", "typo", "moved")))
            if a != b and similar_lines(a, b):
                pairs[n, len(pairs)] = (" ".join(a), " ".join(b))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs.values()) for k in (0, 1)]
    got = {r.row.doc_id: r.n_dropped for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {}
    for i, (n, _) in enumerate(pairs):
        assert got[2 * i] == 0
        share.setdefault(n, []).append(got[2 * i + 1])
    share = {n: sum(x) / len(x) for n, x in share.items()}
    print(line_module.PLANS, share)
    assert min(share.values()) >= 0.9, share


def test_what_is_found_does_not_depend_on_the_size_of_the_table(spark):
    """Ten megabytes without a letter beside them change nothing for 300 hardly similar pairs."""
    r = random.Random(5)
    pairs = []
    while len(pairs) < 300:
        a, b = changed_lines(r, 10, 2, r.choice(("word", "typo")))
        if a != b and similar_lines(a, b):
            pairs.append((" ".join(a), " ".join(b)))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    found = lambda more: {x.row.doc_id: x.n_dropped for x in dedup_lines(spark.createDataFrame(rows + more, "doc_id long, text string")).collect() if x.row.doc_id < 600}
    alone = found([])
    assert sum(alone.values()) > 250
    assert found([(1000 + i, "7" * 1_000_000) for i in range(10)]) == alone


@pytest.mark.parametrize("crowd, broadcast", [(16, 1_000_000), (2, 0)])
def test_lines_against_brute_force(spark, crowd, broadcast, monkeypatch):
    """Nothing is dropped that brute force keeps, and nearly all that it drops goes; also with crowded keys and shuffled texts."""
    monkeypatch.setattr(line_module, "CROWD", crowd)
    monkeypatch.setattr(line_module, "BROADCAST_LINES", broadcast)
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(60)]
    base += ["please call the harbour office before friday noon", "the boat went slowly over it"]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(base).split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            own.append((" ".join(w)).title() + r.choice([".", "!", " 12"]))
        texts.append("\n".join(own))
    texts += [None, "", "\n\n", "***\n123\n***", "Please call the harbour office before monday noon", "Please call the harbour office before friday noon!", "The boat went slowly over its.", "The boat went slowly over it"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rid int")
    want, sure = kept_by(texts, brute_groups), kept_by(texts, lambda words: list(range(len(words))))
    got = [r.row.text for r in sorted(dedup_lines(df).collect(), key=lambda r: r.row.doc_id)]
    number = lambda ts: sum(len(t.split("\n")) for t in ts if t)
    for g, w, s in zip(got, want, sure, strict=True):
        assert (g is None) == (w is None)
        assert set((w or "").split("\n")) - {""} <= set((g or "").split("\n")) <= set((s or "").split("\n")) | {""}
    assert number(sure) - number(got) >= 0.9 * (number(sure) - number(want)) > 20


def test_a_crowd_of_lines_is_one_group(spark):
    """Hundreds of variants of one line, and as many lines that share its words but not their order."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(14)]
    lines = [" ".join(words)]
    for i in range(300):
        w = list(words)
        w[r.randrange(14)] = "".join(r.choice("stuvw") for _ in range(7))
        lines.append(" ".join(w))
    mixed = [" ".join(r.sample(words, 14)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([lines[0]] * 3 + lines[1:] + mixed)], "doc_id long, text string")
    got = {r.row.doc_id: r.n_dropped for r in dedup_lines(df).collect()}
    assert sum(got[i] for i in range(303)) >= 0.98 * 302 and got[0] == 0
    assert sum(got[i] for i in range(303, 343)) <= 2


@pytest.mark.parametrize("n", [400])
def test_pairs_of_a_crowd_grow_with_its_lines(spark, n):
    """A crowd under one key, each row of its own component, makes at most nine pairs a row."""
    rows = spark.range(n).selectExpr("id AS node", "0 AS family", "0L AS fp", "100 AS chars", "1L AS n", "id AS component", "7L AS key", "0 AS at", f"{n}L AS size")
    pairs, crowded = line_module._dealt(rows)
    assert n - 1 <= pairs.distinct().count() <= (line_module.DRAWN + 1) * n
    assert crowded.count() == n


def test_crowds_of_some_dozens_are_compared_in_full_without_texts(spark):
    """60 lines under one key: each two that the letters allow are a pair, none of them is dealt on."""
    r = random.Random(5)
    parts = ["".join(r.choice("etaoinsr") for _ in range(50)), "".join(r.choice("hldcumfp") for _ in range(50))]
    lines = [p[:i] + "x" + p[i + 1 :] for p in parts for i in range(30)]
    norms = spark.createDataFrame(list(enumerate(lines)), "node long, norm string")
    rows = norms.select("node", *line_module._letters(F.col("norm"))).selectExpr("*", "0 AS family", "0L AS fp", "50 AS chars", "1L AS n", "node AS component", "7L AS key", "-1 AS at", "60L AS size")
    pairs, crowded = line_module._dealt(rows)
    assert crowded is None
    assert {(p.u, p.v) for p in pairs.collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if i // 30 == j // 30}


def test_counts_of_letters_lose_no_similar_pair(spark):
    """Lines with up to a fifth of their characters changed, added or taken away, in two alphabets, and lines beyond the limit of characters."""
    r = random.Random(6)
    rows = []
    for i in range(400):
        letters = "etaoinsrhldcumfpgwyb " if i % 2 else "абвгдеetaoi "
        a = list("".join(r.choice(letters) for _ in range(r.choice((6, 30, 80, 300, 420)))))
        b = list(a)
        for _ in range(r.randrange(len(a) // 5 + 1)):
            at = r.randrange(len(b))
            b[at : at + r.randrange(2)] = r.choice(letters) * r.randrange(2)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string")
    row = lambda c: F.struct(F.length(c).alias("chars"), *line_module._letters(F.col(c)))
    df = df.select("x", "y", row("x").alias("a"), row("y").alias("b")).select("*", line_module._may_fit("a", "b").alias("may"), line_module._edits(F.col("x"), F.col("y")).alias("like"))
    got = df.collect()
    assert sum(g.like for g in got) > 300 and all(g.may for g in got if g.like)


def grouped_lines(spark, lines, keys, often):
    """Components of nodes 0, 1, ... of one fingerprint, with the keys (six a line) and numbers of occurrences given."""
    rows = [(i, 1, 0, len(t), often.get(i, 1), *(k if k is not None else 10_000 + 6 * i + j for j, k in enumerate(keys[i]))) for i, t in enumerate(lines)]
    nodes = spark.createDataFrame(rows, "node long, family int, fp long, chars int, n long, " + ", ".join(f"k{t} long" for t in range(6)))
    norms = spark.createDataFrame(list(enumerate(lines)), "node long, norm string")
    found = {}
    for r in line_module._grouped(nodes, 6, lambda wanted: norms.join(wanted, "node", "left_semi")).collect():
        found.setdefault(r.component, set()).add(r.node)
    return sorted(map(sorted, found.values()))


def unlike_lines(n, chars=60):
    r = random.Random(11)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chars)) for _ in range(n)]


@pytest.mark.parametrize("n", [40, 900])
def test_lines_that_share_one_crowded_key_alone_are_compared(spark, n):
    """In a crowd under one key, whose head is like none of them, each line finds its copy (crowds below and above the size that is cut)."""
    lines = unlike_lines(n)
    lines += [t[:30] + "é" + t[31:] for t in lines[1 : n // 2]]
    got = grouped_lines(spark, lines, {i: [7, *[None] * 5] for i in range(len(lines))}, {0: 1000})
    assert got == [[i, n + i - 1] for i in range(1, n // 2)]


@pytest.mark.parametrize("n", [40, 120])
def test_lines_beside_one_that_its_head_takes_are_found(spark, n):
    """Under crowded keys a line is like the head, another like that line but not like the head: all three are one group."""
    lines = unlike_lines(n)
    lines += [lines[0][:50] + "éèêëàâäùûü", "ôöîïçñáíóú" + lines[0][10:50] + "éèêëàâäùûü"]
    got = grouped_lines(spark, lines, {i: [7, 8, *[None] * 4] for i in range(len(lines))}, {0: 1000})
    assert got == [[0, n, n + 1]]


def test_marks_lose_no_similar_pair(spark):
    """Lines with up to a fifth of their characters changed, added or taken away, in several alphabets and beyond the limit of characters; most of the unlike ones go."""
    r = random.Random(8)
    rows = []
    for _ in range(400):
        letters = r.choice(("etaoinsrhldcumfpgwyb ", "абв ", "ab", "𝒜𝒷中文 "))
        a = list("".join(r.choice(letters) for _ in range(r.choice((1, 2, 6, 30, 80, 300, 420)))))
        b = list(a)
        for _ in range(r.randrange(len(a) // 5 + 1)):
            at = r.randrange(len(b)) if b else 0
            b[at : at + r.randrange(2)] = r.choice(letters) * r.randrange(2)
        rows.append(("".join(a), "".join(b)))
    words = unlike_lines(200)
    rows += list(zip(words[::2], words[1::2], strict=True))
    lines = spark.createDataFrame([(2 * i + k, t, "x") for i, p in enumerate(rows) for k, t in enumerate(p)], "node long, norm string, key string")
    nodes = lines.selectExpr("node", "0L AS fp", "length(norm) AS chars", "1 AS family", "node AS component", "node div 2 AS key", "2L AS size")
    got = {(p.u, p.v) for p in line_module._compared(nodes, lines.select("node", "norm")).where("sure").collect()}
    like = spark.createDataFrame([(2 * i, 2 * i + 1, *p) for i, p in enumerate(rows)], "u long, v long, a string, b string").where(line_module._edits(F.col("a"), F.col("b")) & (F.least(F.length("a"), F.length("b")) <= 400))
    assert got == {(p.u, p.v) for p in like.where(line_module._fits(F.length("a"), F.length("b"))).collect()} and len(got) > 200
    marks = line_module._marks(lines.where("node >= 800"))
    marks = marks.withColumn("ones", sum(F.bit_count(f"m{w}") for w in range(line_module.MARKS))).withColumn("free", F.lit(0)).withColumn("chars", F.lit(60))
    pair = marks.alias("a").join(marks.alias("b"), F.expr("a.node % 2 = 0 AND b.node = a.node + 1"))
    assert pair.where(line_module._marks_fit("a", "b")).count() == 0 < pair.count()


def test_no_text_is_broadcast_for_crowds_or_pairs(spark):
    """Even where Spark would take all tables for small, texts are joined by shuffle and lines beyond the limit are not broadcast."""
    lines = spark.createDataFrame([(i, f"line number {i}") for i in range(50)], "node long, norm string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(49)], "u long, v long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(line_module._verified(pairs, lambda wanted: lines))
    rows = spark.range(10).selectExpr("id AS rid")
    many = spark.range(line_module.BROADCAST_LINES + 1).selectExpr("id % 10 AS rid", "id AS pos")
    assert "BroadcastHashJoin" not in plan(line_module._beside(rows, many, "left"))


def test_very_long_lines(spark):
    """Edits of words beyond a thousand characters, shingles beyond thousands of words."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for n in (300, 30_000):
        a = [word() for _ in range(n)]
        b, c = list(a), list(a)
        for k in r.sample(range(n), n // 50):
            b[k] = word()
        for k in r.sample(range(n), n // 2):
            c[k] = word()
        rows += [" ".join(x) for x in (a, b, c)]
    got = dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.row.doc_id: r.n_dropped for r in got} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


def test_line_edge_cases(empty, odd_ids):
    assert dedup_lines(empty).count() == 0
    assert sorted(str(r.row.text) for r in dedup_lines(odd_ids).collect()) == ["", "None", "one two three four", "same text here now"]


def test_near_groups_name_every_row(docs):
    rows = docs.select(F.col("doc_id").alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert near_duplicate_groups(rows).count() == docs.count()
