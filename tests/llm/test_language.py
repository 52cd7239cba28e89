import random
import zlib

import numpy as np

from weftline.llm import language
from weftline.llm.language import BUCKETS, cluster, counts, fit, predict, predict_languages, sample, vectors

WORDS = {
    "aa": "the of and to in that with which from their".split(),
    "bb": "der die und zu den mit für über schön groß".split(),
    "cc": "le la les des être à où été même leçon".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, score string, readable int"


def corpus(n=240, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang, "s", "x", 1) for i in range(n) for lang in [r.choice(list(WORDS))]]


def plain_counts(text):
    raw = b"  " + text.lower().encode().translate(language._LETTERS_ONLY) + b"  "
    out = np.zeros(BUCKETS)
    for size, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            if gram.strip():
                out[(int.from_bytes(gram, "big") * salt % 2**32) >> 19] += 1
    return out


def test_counts(monkeypatch):
    texts = ["Hello, World 42!", "", "é", "ñandú über  $$$", "x" * 50]
    got = counts(texts)
    for g, t in zip(got, texts, strict=True):
        want = plain_counts(t)
        assert np.abs(g - want).sum() <= 2  # the last bytes meet the next text's spaces
    monkeypatch.setattr(language, "_CHUNK", 64)
    long = "The quick brown fox jumps. " * 40
    pieces = counts(["a", long, "b"])[1]
    assert abs(pieces.sum() - plain_counts(long).sum()) < 0.1 * pieces.sum()
    one = vectors(pieces[None, :].copy(), np.ones(BUCKETS, dtype=np.float32))
    other = vectors(plain_counts(long)[None, :].astype(np.float32), np.ones(BUCKETS, dtype=np.float32))
    assert (one @ other.T)[0, 0] > 0.97  # pieces share two characters, so nothing is lost at their borders


def test_clusters():
    r = np.random.default_rng(0)
    x = np.abs(np.concatenate([r.normal(0, 0.02, (30, 6)) + np.eye(6)[k] for k in (0, 2, 4)]))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, own = cluster(x.astype(np.float32), 3)
    assert len(c) == 3 and [len(set(own[i : i + 30])) for i in (0, 30, 60)] == [1, 1, 1]
    odd = np.concatenate([x[:30], x[60:61]]).astype(np.float32)
    assert len(cluster(odd, 2)[0]) == 1  # a lone odd row has no centroid


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = predict_languages(df).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
    held = [g for g in got if g.held_out]
    assert held and sum(g.lang_pred == truth[g.doc_id] for g in held) >= 0.97 * len(held)


def test_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = corpus(150)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    changed = [(i, t, "zz" if held(i) else lang, "other", "y", 7) for i, t, lang, *_ in rows]
    one, two = (sorted(map(tuple, predict_languages(spark.createDataFrame(x, SCHEMA).repartition(n)).collect())) for x, n in ((rows, 2), (changed, 6)))
    assert [r[:3] for r in one] == [r[:3] for r in two]
    assert np.allclose([r[3] for r in one], [r[3] for r in two], atol=1e-5)


def test_against_brute_force(spark):
    """The nearest centroid over plain vectors, with the model's own centroids."""
    rows = corpus(60, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df)
    assert model.centroids.shape[1] == BUCKETS and set(model.langs) == set(WORDS)
    df_count = sum((plain_counts(r[1]) > 0).astype(int) for r in rows)
    idf = np.log((1 + len(rows)) / (1 + df_count)) + 0.1
    same = np.isclose(model.idf, idf, atol=0.05)
    assert same.mean() > 0.99
    for g in predict(df, model).collect():
        v = np.log1p(plain_counts(rows[g.doc_id][1])) * model.idf
        cosines = model.centroids @ (v / np.linalg.norm(v))
        assert abs(cosines.max() - g.score) < 0.03 and cosines[model.langs.index(g.lang_pred) :].size


def test_defined_cases(spark):
    rows = [(i, t, lang, "s", "x", 1) for i, t, lang in [(1, None, "aa"), (2, "", "bb"), (3, "123 $%&", "cc"), (None, "le la les", None), (7, "the of and", "aa"), (7, "the of and", "aa"), (8, "der die und", ""), (9, "日本語テキスト", "jp"), (10, "word " * 300_000, "aa")]]
    got = predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.lang_pred, g.score) for g in got if g.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    learned = {r[2] for r in rows if r[2] is not None}
    assert all(g.lang_pred in learned for g in got if g.doc_id not in (1, 2, 3))
    none = [(1, "some text", None, "s", "x", 1)]
    assert [(g.lang_pred, g.rejected) for g in predict_languages(spark.createDataFrame(none, SCHEMA)).collect()] == [("und", False)]
    assert predict_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rejection(spark):
    df = spark.createDataFrame(corpus(200), SCHEMA)
    model = fit(df)
    odd = spark.createDataFrame([(1, "zzxq wvvk qqyx jjzq xkcd " * 5, None, "s", "x", 1)], SCHEMA)
    assert predict(odd, model).first().rejected
    assert predict(df, model).where("rejected").count() <= 10


def test_sample_is_bounded(spark):
    rows = [(i % 50, f"the of and {i % 200}", "aa" if i % 3 else "bb", "s", "x", 1) for i in range(3000)]
    got = sample(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang"), 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"aa": 20, "bb": 20}
