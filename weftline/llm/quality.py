"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets counts; ratios of them are summarised per language and
source in mergeable quantile sketches. A sketch holds a count per bin of a
whole-number metric (per mille or tenths, the last bin open), so merging is
addition: it is associative, exact and the same on every run, and the sketch of
a language or of the corpus is the sum of the sketches of its sources. Upper
fences read from the sketches replace fixed cutoffs and are joined back.

Fence of a metric in a group: ``q50 + SPREAD * max(q75 - q50, FLOOR)`` in the
bin scale, so a group whose documents are all alike rejects nothing that lies
within the floor. Groups with fewer than ``MIN_GROUP`` documents use the sketch
of their language, and small languages that of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, WORD_GAP, let, materialise

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: metric: (bins, floor of the spread in bins)
METRICS = {"symbols": (1001, 20), "dup_lines": (1001, 60), "repeats": (1001, 60), "word_len": (401, 10)}
SPREAD = 5
MIN_GROUP = 200
#: A table of this many groups at most is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 20_000


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included.

    Windows are compared by 64-bit hash within one text.
    """

    def of(ws: Column) -> Column:
        hashed = F.slice(
            F.transform(ws, lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))),
            1,
            F.greatest(F.size(ws) - 2, F.lit(0)),
        )

        def covered(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            at = F.transform(twice, lambda x: x["i"])
            return let(at, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda v: v + 1)), F.transform(p, lambda v: v + 2))))

        return let(F.sort_array(hashed), covered)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, of))


def count_columns(text: Column) -> dict[str, Column]:
    """The counts of one text, by name; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "n_repeat_words": _repeat_words(words).cast("long"),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of every document; no shuffle."""
    parts = count_columns(docs[text_col])
    counted = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[source_col].alias("source"), *(c.alias(k) for k, c in parts.items()))
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"),
    )


def _bins() -> dict[str, Column]:
    raw = {
        "symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_len": F.expr("10 * word_chars div greatest(n_words, 1)"),
    }
    return {k: F.least(c, F.lit(METRICS[k][0] - 1)).cast("int") for k, c in raw.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, metric, bin, n) of the documents that pass the base rules."""
    kept = measured.where(~base_failed())
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), c.alias("bin")) for k, c in _bins().items()))).alias("m")
    return kept.select("lang", "source", one).groupBy("lang", "source", "m.metric", "m.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per (lang, source): the upper fence of each metric, in bins.

    Works on sketch rows only: their number is bounded by groups times bins.
    """
    levels = [
        sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        for keys in (["lang", "source"], ["lang"], [])
    ]

    def quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys, "metric")
        seen = rows.withColumn("below", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
        q = lambda num, den: F.min(F.when(F.col("below") * den >= F.col("total") * num, F.col("bin")))
        floor = F.expr("CASE metric " + " ".join(f"WHEN '{k}' THEN {f}" for k, (_, f) in METRICS.items()) + " END")
        return seen.groupBy(*keys, "metric").agg(q(1, 2).alias("q50"), q(3, 4).alias("q75"), F.max("total").alias("total")).select(
            *keys, "metric", "total", (F.col("q50") + SPREAD * F.greatest(F.col("q75") - F.col("q50"), floor)).alias("fence")
        )

    def wide(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        """One row a group; a grouping by no key at all is a single row of four numbers."""
        out = [F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(f"{k}_{tag}") for k in METRICS]
        return quantiles(rows, keys).groupBy(*keys).agg(*out, F.max("total").alias(f"total_{tag}"))

    own, lang, corpus = (wide(rows, keys, tag) for rows, keys, tag in zip(levels, (["lang", "source"], ["lang"], []), "slc", strict=True))
    lang = lang.withColumnRenamed("lang", "lang_l")
    joined = own.join(lang, own["lang"].eqNullSafe(lang["lang_l"]), "left").join(F.broadcast(corpus))
    pick = lambda k: F.when(F.col("total_s") >= MIN_GROUP, F.col(f"{k}_s")).when(F.col("total_l") >= MIN_GROUP, F.col(f"{k}_l")).otherwise(F.col(f"{k}_c"))
    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(pick(k).alias(f"fence_{k}") for k in METRICS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Join the fences back; a document is kept if no base rule and no fence rejects it."""
    small = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    same = measured["lang"].eqNullSafe(F.col("g_lang")) & measured["source"].eqNullSafe(F.col("g_source"))
    joined = measured.join(F.broadcast(limits) if small else limits, same, "left")
    over = F.lit(False)
    for k, c in _bins().items():
        over = over | F.coalesce(c > F.col(f"fence_{k}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, **cols: str) -> DataFrame:
    """Counts and verdict of every document.

    Null text: no words, so ``base_failed``. Null language or source: a group of
    its own. Repeated ids stay separate rows. An empty table gives no rows.
    Other columns of ``docs`` are not read, whatever their names.
    """
    measured = materialise(measure(docs, **cols), "quality-counts")
    limits = materialise(fences(sketches(measured)), "quality-fences")
    return judge(measured, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "source", *(f"fence_{k}" for k in METRICS),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Counts and verdict are per row (not per id): each row is given its verdict
    from its own counts, so repeated or null ids do no harm, and any column names
    may occur. Rows are written once with their counts; texts never shuffle. An
    empty table gives no rows.
    """
    inner = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"), F.struct(*(c.alias(k) for k, c in count_columns(docs[text_col]).items())).alias("q"))
    counted = inner.select(
        "row", F.col(f"row.`{lang_col}`").alias("lang"), F.col(f"row.`{source_col}`").alias("source"),
        *(F.col(f"q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")),
        F.col("q.lines.dup").alias("n_dup_lines"), F.col("q.lines.n").alias("n_lines"),
    )
    counted = materialise(counted, "quality-rows")
    limits = materialise(fences(sketches(counted.drop("row"))), "quality-fences")
    return judge(counted, limits).where("kept").select("row.*")
