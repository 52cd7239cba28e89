r"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words ``[^\x20\x09-\x0D]+`` of a text, A-Z lower-cased, then one
end token. The model is ``p(w | context) = p(class(w) | context) * p(w | class(w), context)``.

* Counts: tokens of the training documents by 64-bit hash, one pre-aggregated
  shuffle. They give the base score and the words' shares of their classes.
* Classes: the ``MODEL_TOKENS`` most frequent tokens are clustered by the tokens
  before them; the end token and, by last character and script, all rarer tokens
  have classes of their own. Any token has a class, also one never seen.
* ``p(class | context)`` is a softmax over the sum of weight rows of four
  features: the token before, the one before that and the third (skips), and the
  hashed pair of the last two.
* ``p(w | class, context)`` of a clustered token goes down a tree of its class,
  a softmax over at most ``BRANCH`` children at each node: its words' shares as
  bias, and the rows of two features, the node hashed with the token before and
  with the last two. The hashed tables grow with the training tokens, to a bound.
* Classes of rarer tokens hold any number of words, so a word's share there,
  ``(c + 0.5) / (N_class + 0.5 * (V_class + 1))``, has no features.
* Both are trained by distributed gradient updates: every shard runs AdaGrad over
  all of its training tokens from the shared weights; the weight changes are
  averaged by how often a shard met a row. Shards and their order follow from the
  rows alone, so scores do not depend on how a table is partitioned.

Per document, counts of tokens are needed by score. The ``COUNT_HEAD`` most
frequent tokens go to all tasks (a table of that size, whatever the corpus);
for the others a row per document and token meets the counts in a shuffle join.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, materialise
from .passages import _power, mixed

END = b"\xff"  # no UTF-8 text holds this byte, so no word equals it
COUNT_HEAD = 1 << 18
MODEL_TOKENS = 4096
CLUSTERS = 24
CONTEXTS = 256
RARE = 6  # classes of rarer tokens: {period, comma, other} x {ASCII, not}
CLASSES = CLUSTERS + RARE + 1
START = MODEL_TOKENS + RARE
PAIR_ROWS = 8192
SINGLE = START + 1
ROWS = 3 * SINGLE + PAIR_ROWS + 1  # the last row is the bias
BRANCH = 16
LEVELS = 3  # BRANCH ** LEVELS is MODEL_TOKENS
TREE_ROWS = (1 << 10, 1 << 15)  # rows of each of the two hashed tables: least and most
TOKENS_A_ROW = 256
SHARD_TOKENS = 3_000_000
SHARDS_MOST = 1 << 16
ROUNDS = 1
RATE = 0.3
BATCH = 4096
GROUP_CHARS, GROUP_TOKENS = 600_000, 100_000


def is_held_out(doc_id: int | None) -> bool:
    """By the CRC-32 of the id as text; a null id counts as training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tokens:
    """Token arrays of a group of documents: ``h`` hashes, ``rare`` class by form, ``ends`` positions after each document."""

    def __init__(self, texts: list[str]):
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += t.encode("utf-8", "surrogatepass").lower().split()
            words.append(END)
            ends.append(len(words))
        self.ends = np.array(ends, np.int64)
        data = np.frombuffer(b" ".join(words), np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, stops = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        up, down = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
            self.h = mixed((sums[stops] - sums[starts]) * down[starts])
        last = data[stops - 1]
        other = np.concatenate(([0], np.cumsum(data >= 128)))
        self.rare = (np.where(last == 46, 0, np.where(last == 44, 1, 2)) + 3 * (other[stops] > other[starts])).astype(np.int32)

    @property
    def doc_starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1]))


class HashIndex:
    """From hash to place in an array of distinct hashes; -1 for others. Open addressing, vectorised."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, int(2 * max(1, len(hashes)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, step = np.arange(len(hashes)), 0
        while len(left):
            slot = ((hashes[left] >> self.shift).astype(np.int64) + step) & self.mask
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]  # the last writer of a slot stays
            won = self.places[slot] == left
            self.keys[slot[won]] = hashes[left[won]]
            left, step = left[~won], step + 1
        self.most = step

    def find(self, h: np.ndarray) -> np.ndarray:
        home = (h >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for step in range(self.most):
            slot = (home[todo] + step) & self.mask
            place = self.places[slot]
            hit = (place >= 0) & (self.keys[slot] == h[todo])
            out[todo[hit]] = place[hit]
            todo = todo[~hit & (place >= 0)]
            if not len(todo):
                break
        return out


def token_groups(batches: Iterator[pa.RecordBatch], want=None) -> Iterator[tuple[list, Tokens]]:
    """(doc ids, tokens) of groups of documents of bounded size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if want and not want(doc):
                continue
            text = text.as_py()
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield ids, Tokens(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, Tokens(texts)


def training(doc: int | None) -> bool:
    return not is_held_out(doc)


class Written:
    """Model ids of a group of documents, and ``ends``, as ``Tokens`` has them."""

    def __init__(self, parts: list[np.ndarray]):
        self.ids = np.concatenate(parts).astype(np.int32)
        self.ends = np.cumsum([len(p) for p in parts], dtype=np.int64)

    @property
    def doc_starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1]))


def written_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Written]:
    """Groups of bounded size of rows whose first column holds ids (16 bits each)."""
    parts, size = [], 0
    for batch in batches:
        for cell in batch.column(0):
            parts.append(np.frombuffer(cell.as_buffer(), np.uint16))
            size += len(parts[-1])
            if size >= GROUP_TOKENS:
                yield Written(parts)
                parts, size = [], 0
    if parts:
        yield Written(parts)


def training_ids(texts: DataFrame, index: HashIndex) -> DataFrame:
    """(mark, ids) of the training documents, written down, so that their texts are split into words once for all that learns from them.

    ``mark`` follows from id and text; ``ids`` holds 16 bits a token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, t in token_groups(batches):
            ids = model_ids(t, index).astype(np.uint16)
            cells = [ids[a:b].tobytes() for a, b in zip(t.doc_starts, t.ends, strict=True)]
            yield pa.record_batch([pa.array(marks, pa.int64()), pa.array(cells, pa.binary())], names=["mark", "ids"])

    rows = texts.where("doc_id IS NULL OR crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").select(F.xxhash64("doc_id", "text").alias("mark"), "text")
    return materialise(rows.mapInArrow(run, "mark long, ids binary"), "lm-ids")


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, rare, c) of all tokens of the training documents; tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            h, rare = (np.concatenate(x) for x in zip(*waiting, strict=True))
            values, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.record_batch([pa.array(values.view(np.int64)), pa.array(rare[first].astype(np.int32)), pa.array(n)], names=["h", "rare", "n"])

        for _, t in token_groups(batches, training):
            waiting.append((t.h, t.rare))
            size += len(t.h)
            if size >= 4_000_000:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.mapInArrow(run, "h long, rare int, n long").groupBy("h", "rare").agg(F.sum("n").alias("c"))


def model_ids(t: Tokens, index: HashIndex) -> np.ndarray:
    found = index.find(t.h)
    return np.where(found >= 0, found, MODEL_TOKENS + t.rare).astype(np.int32)


def before(ids: np.ndarray, t: Tokens, by: int) -> np.ndarray:
    """The token ``by`` places before each, START at a document's beginning."""
    out = np.full(len(ids), START, np.int32)
    out[by:] = ids[:-by] if by < len(ids) else START
    for k in range(by):
        at = t.doc_starts + k
        out[at[at < t.ends]] = START
    return out


def feature_rows(ids: np.ndarray, t: Tokens) -> np.ndarray:
    """(tokens x 4) weight rows: the three tokens before, and the hashed pair."""
    one, two, three = before(ids, t, 1), before(ids, t, 2), before(ids, t, 3)
    pair = mixed(one.astype(np.uint64) * np.uint64(1_000_003) + two.astype(np.uint64)) % np.uint64(PAIR_ROWS)
    return np.stack((one, SINGLE + two, 2 * SINGLE + three, 3 * SINGLE + pair.astype(np.int32)), axis=1)


def cluster(table: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k-means of the rows' square-rooted context distributions; starts are spread out from the most frequent row."""
    x = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
    centers = [x[int(weight.argmax())]]
    far = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        centers.append(x[int((far * np.log1p(weight)).argmax())])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(axis=1))
    c = np.array(centers)
    for _ in range(15):
        near = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        for j in range(k):
            if (near == j).any():
                c[j] = np.average(x[near == j], axis=0, weights=weight[near == j])
    return near


def learn_classes(learning: DataFrame, index: HashIndex, counts: np.ndarray) -> np.ndarray:
    """The class of each model id, START included, from rows of ``training_ids``."""
    m = len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CONTEXTS * MODEL_TOKENS, np.int64)
        for t in written_groups(batches):
            ids, prev = t.ids, before(t.ids, t, 1)
            ok = (ids < MODEL_TOKENS) & (prev < CONTEXTS)
            table += np.bincount(prev[ok].astype(np.int64) * MODEL_TOKENS + ids[ok], minlength=len(table))
        cell = np.flatnonzero(table)
        yield pa.record_batch([pa.array(cell), pa.array(table[cell])], names=["cell", "n"])

    cells = learning.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CONTEXTS x MODEL_TOKENS rows
    table = np.zeros(CONTEXTS * MODEL_TOKENS)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    classes = np.zeros(START + 1, np.int8)
    if m:
        classes[:m] = cluster(table.reshape(CONTEXTS, MODEL_TOKENS).T[:m], counts.astype(float), min(CLUSTERS, m))
    end = index.find(Tokens([""]).h)[0]
    if end >= 0:
        classes[end] = CLASSES - 1
    classes[MODEL_TOKENS : MODEL_TOKENS + RARE] = CLUSTERS + np.arange(RARE)
    return classes


def class_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]] + weights[-1]
    for k in range(1, rows.shape[1]):
        out += weights[rows[:, k]]
    out -= out.max(axis=1, keepdims=True)
    return out


class Trees:
    """The words of each cluster as leaves of a tree, by falling count; at each of ``LEVELS`` a node (-1: none) and a child."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, train_tokens: int):
        m = len(counts)
        self.node, self.child = np.full((m, LEVELS), -1, np.int32), np.zeros((m, LEVELS), np.int32)
        n_nodes = 0
        for c in np.unique(classes):
            words = np.flatnonzero(classes == c)
            words = words[np.argsort(-counts[words], kind="stable")]
            place = np.arange(len(words))
            depth = next(d for d in range(LEVELS + 1) if BRANCH**d >= len(words))
            for level in range(depth):
                below = BRANCH ** (depth - level - 1)
                group, at = np.unique(place // (below * BRANCH), return_inverse=True)
                self.node[words, level], self.child[words, level] = n_nodes + at, place // below % BRANCH
                n_nodes += len(group)
        share = np.zeros((max(1, n_nodes), BRANCH))
        for level in range(LEVELS):
            at = self.node[:, level] >= 0
            np.add.at(share, (self.node[at, level], self.child[at, level]), counts[at] + 0.5)
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(share / np.maximum(share.sum(axis=1, keepdims=True), 1)), -30).astype(np.float32)
        self.rows = int(np.clip(1 << max(0, int(train_tokens // TOKENS_A_ROW) - 1).bit_length(), *TREE_ROWS))
        self.shift = np.uint64(64 - (self.rows - 1).bit_length())

    def steps(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(places of tokens, nodes, children, rows in both tables) of each level."""
        last = one.astype(np.uint64) * np.uint64(1_000_003)
        with np.errstate(over="ignore"):
            pair = (last + two.astype(np.uint64)) * np.uint64(0xA0761D6478BD642F)
        for level in range(LEVELS):
            at = np.flatnonzero(ids < len(self.node))
            at = at[self.node[ids[at], level] >= 0]
            if not len(at):
                return
            node = self.node[ids[at], level]
            with np.errstate(over="ignore"):
                salt = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                rows = [((f[at] + salt) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.uint16) for f in (last, pair)]
            yield at, node, self.child[ids[at], level], *rows

    def logits(self, weights: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.bias[node]
        out += weights[0][a]
        out += weights[1][b]
        out -= out.max(axis=1, keepdims=True)
        return out


def shards(learning: DataFrame, tokens: int) -> DataFrame:
    """The training rows (ids, shard) in shards and an order that follow from their ids and texts.

    Equal rows change places only with each other; all of them lie in one shard. A
    task may hold several shards, one after another.
    """
    n = int(min(SHARDS_MOST, max(1, -(-tokens // SHARD_TOKENS))))
    numbered = learning.withColumn("shard", F.pmod("mark", F.lit(n)))
    return numbered.repartition(n, "shard").sortWithinPartitions("shard", "mark", "ids").select("ids", "shard")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each shard in turn; each is to be read to its end before the next."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column(1).to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b > a:
                    yield int(shard[a]), batch.slice(a, b - a)

    for _, own in itertools.groupby(pieces(), key=lambda x: x[0]):
        yield (batch for _, batch in own)


class _Table:
    """Weight rows of one shard under AdaGrad, one step size a row."""

    def __init__(self, weights: np.ndarray):
        self.start, self.now = weights, weights.copy()
        self.seen, self.power = np.zeros(len(weights)), np.full(len(weights), 1e-6, np.float32)

    def update(self, rows: np.ndarray, errors: np.ndarray) -> None:
        """A step against the summed errors of each row; rows are 16-bit, which sorts by radix."""
        order = np.argsort(rows, kind="stable")
        own = rows[order]
        edge = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        g = np.add.reduceat(errors[order], edge, axis=0)
        self.step(own[edge].astype(np.int64), g, np.diff(np.concatenate((edge, [len(own)]))))

    def step(self, at: np.ndarray, g: np.ndarray, times) -> None:
        self.seen[at] += times
        self.power[at] += (g * g).mean(axis=1)
        self.now[at] -= RATE * g / np.sqrt(self.power[at])[:, None]

    def changes(self, first: int, names: list[str]) -> pa.RecordBatch:
        at = np.flatnonzero(self.seen)
        change = (self.now[at] - self.start[at]).astype(np.float64) * self.seen[at][:, None]
        wide = change.shape[1]
        cells = [pa.array(np.ascontiguousarray(change[:, c])) if c < wide else pa.nulls(len(at), pa.float64()) for c in range(CLASSES)]
        return pa.record_batch([pa.array(at + first), pa.array(self.seen[at]), *cells], names=names)


def _softmax_errors(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), chosen] -= 1
    return z


def train_round(docs: DataFrame, classes: np.ndarray, trees: Trees, weights: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of gradient updates over all training tokens; bounded sums come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_shard(batches):
            top, tables = _Table(weights), [_Table(x) for x in within]
            for t in written_groups(part):
                ids = t.ids
                rows, target = feature_rows(ids, t).astype(np.uint16), classes[ids]
                for at in range(0, len(ids), BATCH):
                    r, y = rows[at : at + BATCH], target[at : at + BATCH]
                    p = _softmax_errors(class_logits(top.now, r), y)
                    for k in range(4):
                        top.update(r[:, k], p)
                    top.step(np.array([ROWS - 1]), p.sum(axis=0, keepdims=True), len(y))
                    one, two = r[:, 0], r[:, 1] - np.uint16(SINGLE)
                    for _, node, child, a, b in trees.steps(ids[at : at + BATCH], one, two):
                        p = _softmax_errors(trees.logits([x.now for x in tables], node, a, b), child)
                        tables[0].update(a, p)
                        tables[1].update(b, p)
            yield top.changes(0, names)
            for k, table in enumerate(tables):
                yield table.changes(ROWS + k * trees.rows, names)

    names = ["row", "n", *(f"d{c}" for c in range(CLASSES))]
    schema = "row long, n double, " + ", ".join(f"d{c} double" for c in range(CLASSES))
    sums = docs.mapInArrow(run, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()  # at most ROWS + 2 * TREE_ROWS rows
    new, inner = weights.copy(), within.copy().reshape(-1, BRANCH)
    at, n = sums["row"].to_numpy(), sums["n"].to_numpy()
    top = at < ROWS
    for c in range(CLASSES):
        change = sums[f"d{c}"].to_numpy() / n
        new[at[top], c] += change[top].astype(np.float32)
        if c < BRANCH:
            inner[at[~top] - ROWS, c] += change[~top].astype(np.float32)
    return new, inner.reshape(within.shape)


def _head(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = counts.orderBy(F.desc("c"), "h").limit(n).toArrow()
    return top["h"].to_numpy().view(np.uint64), top["rare"].to_numpy().astype(np.int64), top["c"].to_numpy()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Null text counts as empty (its end token only). A null id counts as
    training. Repeated rows are scored each (and counted each). An empty table
    gives no rows; with no training documents all tokens are unknown.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs, id_col, text_col)
    counts = materialise(token_counts(texts), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head_h, head_rare, head_c = _head(counts, COUNT_HEAD)
    model_h, model_c = head_h[:MODEL_TOKENS], head_c[:MODEL_TOKENS]
    index = HashIndex(model_h)
    written = training_ids(texts, index)
    classes = learn_classes(written, index, model_c)

    # counts and distinct tokens of each class: rare classes from all counts, less the tokens that have a cluster
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        n_class[CLUSTERS + r["rare"]], v_class[CLUSTERS + r["rare"]] = r["c"], r["v"]
    np.subtract.at(n_class, CLUSTERS + head_rare[:MODEL_TOKENS], model_c)
    np.subtract.at(v_class, CLUSTERS + head_rare[:MODEL_TOKENS], 1)
    own = classes[: len(model_h)]
    np.add.at(n_class, own, model_c)
    np.add.at(v_class, own, 1)
    in_class = np.log10(n_class + 0.5 * (v_class + 1))
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[-1] = np.log((n_class + 1) / (n_class.sum() + CLASSES))
    trees = Trees(own, model_c, int(total))
    within = np.zeros((2, trees.rows, BRANCH), np.float32)
    learning = shards(written, int(total))
    for _ in range(rounds):
        weights, within = train_round(learning, classes, trees, weights, within)
    return _scored(spark, texts, counts, (head_h, head_c), index, classes, trees, weights, within, in_class, int(total), int(distinct))


def _scored(spark: SparkSession, texts: DataFrame, counts: DataFrame, head, index: HashIndex, classes: np.ndarray, trees: Trees, weights: np.ndarray, within: np.ndarray, in_class: np.ndarray, total: int, distinct: int) -> DataFrame:
    head_index, worth = HashIndex(head[0]), np.log10(head[1] + 0.5)
    shared = spark.sparkContext.broadcast((head_index, worth, index, classes, trees, weights, within, in_class))  # sizes fixed by the constants above
    none = float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_index, worth, index, classes, trees, weights, within, in_class = shared.value
        row = TaskContext.get().partitionId() << 40
        for docs, t in token_groups(batches):
            starts, n = t.doc_starts, np.diff(np.concatenate(([0], t.ends)))
            ids = model_ids(t, index)
            rows, cls = feature_rows(ids, t), classes[ids]
            value = -in_class[cls]
            for at in range(0, len(ids), BATCH):
                z = class_logits(weights, rows[at : at + BATCH])
                chosen = z[np.arange(len(z)), cls[at : at + BATCH]]
                value[at : at + BATCH] += (chosen - np.log(np.exp(z, out=z).sum(axis=1))) / np.log(10)
                some = ids[at : at + BATCH]
                leaves = np.flatnonzero(some < len(trees.node))
                value[at + leaves] += in_class[cls[at + leaves]] - worth[some[leaves]]  # the tree takes the place of the share
                for where, node, child, a, b in trees.steps(some, rows[at : at + BATCH, 0], rows[at : at + BATCH, 1] - SINGLE):
                    z = trees.logits(within, node, a, b)
                    chosen = z[np.arange(len(z)), child]
                    value[at + where] += (chosen - np.log(np.exp(z, out=z).sum(axis=1))) / np.log(10)
            place = head_index.find(t.h)
            known = place >= 0
            counted = np.where(known, worth[np.maximum(place, 0)] if len(worth) else none, none)
            add = lambda x: np.add.reduceat(x, starts)
            number = row + np.arange(len(docs))
            row += len(docs)
            null = pa.nulls(len(docs), pa.int64())
            yield pa.record_batch(
                [pa.array(number), pa.array(docs, pa.int64()), pa.array([is_held_out(d) for d in docs]), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(counted)), pa.array(add(value)), null, null],
                names=_names,
            )
            rest = np.flatnonzero(~known)
            if len(rest) and len(head[0]) == COUNT_HEAD:
                owner = np.searchsorted(t.ends, rest, side="right")
                order = np.lexsort((t.h[rest], owner))
                o, h = owner[order], t.h[rest][order]
                edge = np.concatenate(([0], np.flatnonzero((np.diff(o) != 0) | (h[1:] != h[:-1])) + 1))
                times = np.diff(np.concatenate((edge, [len(o)])))
                k = len(edge)
                yield pa.record_batch(
                    [pa.array(number[o[edge]]), *(pa.nulls(k, x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(h[edge].view(np.int64)), pa.array(times)],
                    names=_names,
                )

    _names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "value", "h", "times"]
    out = materialise(texts.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, value double, h long, times long"), "lm-scores")
    met = out.where("h IS NOT NULL").select("row", "h", "times").join(counts, "h").select("row", "times", (F.col("times") * (F.log10(F.col("c") + 0.5) - none)).alias("gain"))
    gains = met.groupBy("row").agg(F.sum("times").alias("more"), F.sum("gain").alias("gain"))
    scored = out.where("h IS NULL").join(gains, "row", "left")
    counted = F.col("counted") + F.coalesce("gain", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), (counted + F.col("value")).alias("score"),
    )
