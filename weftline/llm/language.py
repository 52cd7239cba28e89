"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of byte n-grams (2 and 3 bytes of the lower-cased
text, other ASCII than letters read as a space), hashed into ``BUCKETS``. Document
frequencies count every training document. Each language's centroids are clusters (spherical
k-means) of a sample of its training documents, at most ``SAMPLE`` a language, chosen by hash;
that bound is the only one. A text takes the language of the centroid with the largest
cosine; it is marked as rejected where that cosine is lower than nearly all of the centroid's own
members had.

The model has languages x ``CENTROIDS`` x ``BUCKETS`` numbers, whatever the number of documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text if
nothing was learned; null ids hash as empty text; rows with a null language are predicted and
not learned from; repeated rows count as often as they stand there, but one copy enters the
sample; texts of any length are read whole; of equal cosines the first language by name counts.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
BUCKETS = 8_192
CENTROIDS = 4
SAMPLE = 1_500
ROUNDS = 12
#: A cluster with a smaller share of its language's sample is left out: it holds wrong labels and odd texts.
LEAST_SHARE = 0.05
#: Share of a centroid's own members that fall below its threshold.
REJECTED = 0.005
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CHUNK, _ROWS = 1 << 20, 128
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _chunks(texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
    """(row, bytes) of texts; long ones come in pieces that share two characters."""
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _CHUNK):
            yield row, b"  " + text[max(at - 2, 0) : at + _CHUNK].lower().encode("utf-8", "replace").translate(_LETTERS_ONLY) + b"  "


def counts(texts: list[str]) -> np.ndarray:
    """A row of bucket counts for each text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)

    def add(rows: list[int], parts: list[bytes]) -> None:
        at = np.repeat(np.array(rows, dtype=np.int64) * BUCKETS, [len(p) for p in parts])
        a = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
        two = (a[:-1] << 8) | a[1:]
        for code, salt in ((two, 0x9E3779B1), ((two[:-1] << 8) | a[2:], 0x85EBCA6B)):
            word = (code & 0xDFDFDF) > 0  # something else than spaces
            bucket = ((code * np.uint32(salt)) >> np.uint32(19)).astype(np.int64) + at[: len(code)]
            low = int(at[0])
            found = np.bincount(bucket[word] - low)
            out.reshape(-1)[low : low + len(found)] += found

    rows, parts, size = [], [], 0
    for row, part in _chunks(texts):
        if parts and size + len(part) > _CHUNK:
            add(rows, parts)
            rows, parts, size = [], [], 0
        rows.append(row)
        parts.append(part)
        size += len(part)
    if parts:
        add(rows, parts)
    return out


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF; a row without n-grams stays zero."""
    flat = n.reshape(-1)
    held = np.flatnonzero(flat)
    flat[held] = np.log1p(flat[held])
    n *= idf
    size = np.sqrt(np.einsum("ij,ij->i", n, n))
    n /= np.where(size > 0, size, 1)[:, None]
    return n


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


@dataclass(frozen=True)
class Model:
    """Centroids (rows) with their languages and least cosines."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, dtype=np.int64)
    for b in _by_rows(batches):
        df += (counts(b.column("text").to_pylist()) > 0).sum(axis=0)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["bucket", "df"])


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, begun with the mean's nearest row and then the rows farthest from those chosen. Gives centroids and each row's own."""
    first = int((x @ x.mean(axis=0)).argmax())
    chosen, near = [first], x @ x[first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    own = None
    for _ in range(rounds):
        now = (x @ c.T).argmax(axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        sums = np.stack([x[own == i].sum(axis=0) for i in range(len(c))])
        size = np.linalg.norm(sums, axis=1)
        c = sums[size > 0] / size[size > 0][:, None]
    size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    c = c[(size >= LEAST_SHARE * len(x)) | (size == size.max())].astype(np.float32)
    return c, (x @ c.T).argmax(axis=1)


def sample(training: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(lang, text): at most ``most`` different training documents a language, the least by hash.

    The languages' estimated counts of different documents give a hash limit under which about twice as many rows lie, so
    that only those are grouped and ranked.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(1 << 30))
    rows = training.withColumn("chance", chance)
    sizes = rows.groupBy("lang").agg((F.lit(2.0 * most) / F.approx_count_distinct("chance") * (1 << 30)).alias("limit"))
    near = rows.join(F.broadcast(sizes), "lang").where(F.col("chance") <= F.col("limit"))
    single = near.groupBy("lang", "chance").agg(F.min("text").alias("text"))
    ranked = single.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("chance")))
    return ranked.where(F.col("rn") <= most).select("lang", "text")


def fit(docs: DataFrame, most: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from rows (doc_id, text, lang) with text and language."""
    training = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    found = training.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS)
    for r in found:
        df[r.bucket] = r.df
    n = training.select("doc_id").count()
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([vectors(counts(pdf["text"].iloc[at : at + _ROWS].tolist()), idf) for at in range(0, len(pdf), _ROWS)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c, own = cluster(x, k)
        cosines = np.einsum("ij,ij->i", x, c[own])
        least = [float(np.quantile(cosines[own == i], REJECTED)) if (own == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "centroid": [r.tobytes() for r in c], "least": least})

    rows = sorted(sample(training, most).groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, least double").collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    c = np.stack([np.frombuffer(r.centroid, dtype=np.float32) for r in rows]) if rows else np.zeros((0, BUCKETS), dtype=np.float32)
    return Model(idf, [r.lang for r in rows], c, np.array([r.least for r in rows]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of rows (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x buckets

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _by_rows(batches):
            read = np.array(b.column("readable").to_pylist(), dtype=bool) & bool(m.langs)
            lang, score, rejected = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            at = np.flatnonzero(read)
            if len(at):
                cosines = vectors(counts(b.column("text").take(pa.array(at)).to_pylist()), m.idf) @ m.centroids.T
                best = cosines.argmax(axis=1)
                lang[at] = np.array(m.langs, dtype=object)[best]
                score[at] = np.clip(cosines[np.arange(len(at)), best], 0, 1)
                rejected[at] = score[at] < m.least[best]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, _OUT)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32 of the id leaves a remainder by 5, predict all."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return predict(rows, fit(rows.where(remainder(F.col("doc_id")) != 0)))
