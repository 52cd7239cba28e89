"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A file is a Parquet table with a binary column of blocks; Spark's writer commits
it, so a lost executor leaves no half-written part. A row holds whole documents:
one block of about ``BLOCK_IDS`` ids, or, for a longer document, as many blocks one
after another as it takes, so no block is longer and memory does not grow with a
text. Every block can be read alone:

    magic "WID1", u32 documents, u32 ids, u32 coded bytes, u32 crc32 of the rest,
    u32 ids of each document, u32 words of each lane, the lanes' words (u16)

Coding. The ids of a block are cut into ``LANES`` runs that are coded side by
side, one id of each a step; all lanes use and train the block's one model, which
starts empty in every block. Per id:

1. Is it the id last seen after the same two ids (order 2)? The probability mixes
   two adaptive estimates, by the order-2 slot's confidence and by the order-1
   slot's confidence and agreement, with adaptive weights.
2. If not: is it the id last seen after the same one id (order 1)?
3. If not: was it met in this block when the last table was built (after 8, 16, 32, ... steps)? Then it is
   coded by its count (order 0), else by its 16 bits.

Probabilities are whole numbers of 2**16, so a reader on any machine follows
them exactly. The coder is a carry-less range coder with a 48-bit low end and
16-bit output; many blocks are coded at once in numpy, one lane each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, materialise, partitions_for
from .tokens import groups_by_size, library_tokenizer

MAGIC = b"WID1"
BLOCK_IDS = 1 << 16
LANES = 64
TOGETHER = 96  # blocks coded at once
SYMBOLS = 1 << 16
ONE_SLOTS, TWO_SLOTS = 1 << 12, 1 << 14
REBUILD = 8  # the first step with an order-0 table; the next ones come after twice, four times, ... as many
COARSE = 64
RATE = 6
END_ID = 1
_ONE = 1 << 16
_TOP, _LOW48 = np.uint64(1 << 32), np.uint64((1 << 48) - 1)
_S16, _S32 = np.uint64(16), np.uint64(32)


class _Coder:
    """Range coder states of all lanes; ``put`` when writing, ``target`` and ``take`` when reading."""

    def __init__(self, lanes: int, room: int, words: np.ndarray | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 48) - 1, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        self.reading = words is not None
        self.words = words if self.reading else np.zeros((lanes, room), np.uint16)
        self.code = np.zeros(lanes, np.uint64)
        if self.reading:
            for _ in range(3):
                self._read(np.arange(lanes))

    def _read(self, who: np.ndarray) -> None:
        at = self.at[who]
        inside = at < self.words.shape[1]
        word = np.where(inside, self.words[who, np.minimum(at, self.words.shape[1] - 1)], 0).astype(np.uint64)
        self.code[who] = ((self.code[who] << _S16) | word) & _LOW48
        self.at[who] = at + 1

    def narrow(self, who: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Code [start, start + width) of 2**16 in the lanes ``who``."""
        part = self.range[who] >> _S16
        low = self.low[who] + part * start.astype(np.uint64)
        size = part * width.astype(np.uint64)
        todo = np.flatnonzero(size < _TOP)
        while len(todo):
            lo, sz, lanes = low[todo], size[todo], who[todo]
            settled = ((lo ^ (lo + sz)) >> _S32) == 0
            sz = np.where(settled, sz, (_TOP - (lo & (_TOP - np.uint64(1)))))
            if self.reading:
                self._read(lanes)
            else:
                self.words[lanes, self.at[lanes]] = (lo >> _S32).astype(np.uint16)
                self.at[lanes] += 1
            low[todo] = (lo << _S16) & _LOW48
            size[todo] = (sz << _S16) & _LOW48
            todo = todo[size[todo] < _TOP]
        self.low[who], self.range[who] = low, size

    def target(self, who: np.ndarray) -> np.ndarray:
        """Which of the 2**16 points the code is at."""
        return np.minimum((((self.code[who] - self.low[who]) & _LOW48) // (self.range[who] >> _S16)).astype(np.int64), _ONE - 1)

    def finish(self) -> None:
        lanes = np.arange(len(self.low))
        for shift in (32, 16, 0):
            self.words[lanes, self.at] = ((self.low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            self.at += 1


class _Model:
    """The predictions of ``blocks`` blocks; ``block`` is each lane's."""

    def __init__(self, blocks: int):
        self.blocks, lanes = blocks, blocks * LANES
        self.block = np.repeat(np.arange(blocks), LANES)
        self.guess = [np.zeros(blocks * n, np.int64) for n in (ONE_SLOTS, TWO_SLOTS)]
        self.trust = [np.zeros(blocks * n, np.int64) for n in (ONE_SLOTS, TWO_SLOTS)]
        self.by_two, self.by_one, self.by_rest, self.by_seen = (np.full(blocks * n, _ONE // 2, np.int64) for n in (16, 32, 16, 1))
        self.weight = np.full(blocks, _ONE // 2, np.int64)
        self.count = np.zeros((blocks, SYMBOLS), np.int32)
        self.built = np.zeros((blocks, SYMBOLS + 1), np.int32)
        # for reading: the symbols met, their starts, and where each stretch of COARSE points begins among them
        self.met, self.edge = np.zeros((blocks, SYMBOLS), np.int32), np.full((blocks, SYMBOLS + 1), _ONE, np.int32)
        self.coarse = np.zeros((blocks, _ONE // COARSE + 1), np.int32)
        self.last, self.last_but = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def look(self, who: np.ndarray) -> None:
        b = self.block[who]
        self.slot1 = b * ONE_SLOTS + ((self.last[who] * 40503) >> 4) % ONE_SLOTS
        self.slot2 = b * TWO_SLOTS + ((self.last[who] * 40503 + self.last_but[who] * 30011) >> 3) % TWO_SLOTS
        self.g1, self.g2 = self.guess[0][self.slot1], self.guess[1][self.slot2]
        t1, t2 = self.trust[0][self.slot1], self.trust[1][self.slot2]
        self.ctx2 = b * 16 + t2
        self.ctx1 = b * 32 + 2 * t1 + (self.g1 == self.g2)
        self.rest = b * 16 + t1
        w = self.weight[b]
        self.p2a, self.p2b = self.by_two[self.ctx2], self.by_one[self.ctx1]
        self.p2 = np.clip((w * self.p2a + (_ONE - w) * self.p2b) >> 16, 64, _ONE - 64)
        self.p1 = np.clip(self.by_rest[self.rest], 64, _ONE - 64)
        self.ps = np.clip(self.by_seen[b], 64, _ONE - 64)

    @staticmethod
    def _move(table: np.ndarray, at: np.ndarray, bit: np.ndarray) -> None:
        change = ((bit.astype(np.int64) << 16) - table[at]) >> RATE
        n = np.bincount(at, minlength=len(table))
        table += (np.bincount(at, weights=change, minlength=len(table)) / np.maximum(n, 1) * np.minimum(n, 4)).astype(np.int64)
        np.clip(table, 32, _ONE - 32, out=table)

    def learn(self, who: np.ndarray, ids: np.ndarray, two: np.ndarray, one: np.ndarray, seen: np.ndarray) -> None:
        b = self.block[who]
        self._move(self.by_two, self.ctx2, two)
        self._move(self.by_one, self.ctx1, two)
        if (miss := ~two).any():
            self._move(self.by_rest, self.rest[miss], one[miss])
            if (miss := miss & ~one).any():
                self._move(self.by_seen, b[miss], seen[miss])
        better = np.where(two, self.p2a - self.p2b, self.p2b - self.p2a)  # towards the estimate that was nearer the truth
        self.weight = np.clip(self.weight + (np.bincount(b, weights=better, minlength=self.blocks) / 64).astype(np.int64), 2048, _ONE - 2048)
        for k, slot, guess in ((0, self.slot1, self.g1), (1, self.slot2, self.g2)):
            trust = self.trust[k][slot]
            hit = guess == ids
            self.guess[k][slot] = np.where(hit | (trust > 1), guess, ids)
            self.trust[k][slot] = np.where(hit, np.minimum(trust + 1, 15), np.where(trust > 1, trust // 2, 1))
        self.last_but[who], self.last[who] = self.last[who], ids

    def rebuild(self, ids: np.ndarray, length: np.ndarray, since: int, until: int) -> None:
        """Order-0 tables from all ids so far, scaled to 2**16; those of steps since..until are new."""
        there = np.arange(since, until)[None, :] < length[:, None]
        np.add.at(self.count.reshape(-1), (self.block[:, None] * SYMBOLS + ids[:, since:until])[there], 1)
        for k in range(self.blocks):  # a row at a time stays in cache
            count = self.count[k]
            met = np.flatnonzero(count)
            share = 1 + count[met].astype(np.int64) * max(_ONE - 1 - len(met), 0) // max(int(count[met].sum()), 1)
            row = self.built[k]
            row[:] = 0
            row[met + 1] = share
            np.cumsum(row, out=row)
            self.met[k, : len(met)] = met
            self.edge[k, : len(met)] = row[met]
            self.edge[k, len(met) :] = _ONE
            self.coarse[k] = np.maximum(np.searchsorted(self.edge[k, : len(met)], np.arange(0, _ONE + 1, COARSE), side="right") - 1, 0)


def _shape(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First id and number of ids of every lane."""
    first, length = [], []
    for n in sizes:
        edge = n * np.arange(LANES + 1) // LANES
        first.append(edge[:-1])
        length.append(np.diff(edge))
    return np.concatenate(first), np.concatenate(length)


def _run(sizes: list[int], coder: _Coder, ids: np.ndarray) -> np.ndarray:
    """Codes (or, when reading, fills in) ``ids``, lanes x steps."""
    _, length = _shape(sizes)
    model = _Model(len(sizes))
    built, due = 0, REBUILD
    for step in range(int(length.max(initial=0))):
        if step == due:
            model.rebuild(ids, length, built, step)
            built, due = step, 2 * step
        who = np.flatnonzero(length > step)
        model.look(who)
        b, n = model.block[who], len(who)
        if coder.reading:
            two = coder.target(who) < model.p2
        else:
            real = ids[who, step]
            two = real == model.g2
        coder.narrow(who, np.where(two, 0, model.p2), np.where(two, model.p2, _ONE - model.p2))
        one, seen = np.zeros(n, bool), np.zeros(n, bool)
        k = np.flatnonzero(~two)
        if len(k):
            one[k] = coder.target(who[k]) < model.p1[k] if coder.reading else real[k] == model.g1[k]
            coder.narrow(who[k], np.where(one[k], 0, model.p1[k]), np.where(one[k], model.p1[k], _ONE - model.p1[k]))
        k = np.flatnonzero(~two & ~one)
        if len(k):
            seen[k] = coder.target(who[k]) < model.ps[k] if coder.reading else model.built[b[k], real[k] + 1] > model.built[b[k], real[k]]
            coder.narrow(who[k], np.where(seen[k], 0, model.ps[k]), np.where(seen[k], model.ps[k], _ONE - model.ps[k]))
        old, new = np.flatnonzero(seen), np.flatnonzero(~two & ~one & ~seen)
        if coder.reading:
            real = np.where(two, model.g2, model.g1)
            if len(old):
                real[old] = _search(model, b[old], coder.target(who[old]))
            if len(new):
                real[new] = coder.target(who[new])
            ids[who, step] = real
        if len(old):
            start = model.built[b[old], real[old]]
            coder.narrow(who[old], start, model.built[b[old], real[old] + 1] - start)
        if len(new):
            coder.narrow(who[new], real[new], np.ones(len(new), np.int64))
        model.learn(who, real, two, one, seen)
    return ids


def _search(model: _Model, block: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The symbol whose range holds the point. A symbol is at least one point wide, so few lie in a coarse stretch."""
    low, high = model.coarse[block, point // COARSE], model.coarse[block, point // COARSE + 1]
    while (high > low).any():
        mid = (low + high + 1) >> 1
        below = model.edge[block, mid] <= point
        low, high = np.where(below, mid, low), np.where(below, high, mid - 1)
    return model.met[block, low]


def encode_blocks(blocks: list[list[np.ndarray]]) -> list[bytes]:
    """Payloads of blocks, each a list of documents' ids; ids of ``SYMBOLS`` or more raise ValueError."""
    if any(len(d) and int(d.max()) >= SYMBOLS for docs in blocks for d in docs):
        raise ValueError(f"ids must be below {SYMBOLS}")
    out = []
    for at in range(0, len(blocks), TOGETHER):
        group = blocks[at : at + TOGETHER]
        flat = [np.concatenate(docs).astype(np.int64) if docs else np.empty(0, np.int64) for docs in group]
        first, length = _shape([len(x) for x in flat])
        ids = np.zeros((len(first), int(length.max(initial=0))), np.int64)
        for lane, (f, n) in enumerate(zip(first, length, strict=True)):
            ids[lane, :n] = flat[lane // LANES][f : f + n]
        coder = _Coder(len(first), 3 * ids.shape[1] + 16)
        _run([len(x) for x in flat], coder, ids)
        coder.finish()
        for k, docs in enumerate(group):
            lanes = slice(k * LANES, (k + 1) * LANES)
            words = coder.at[lanes]
            body = np.array([len(d) for d in docs], "<u4").tobytes() + words.astype("<u4").tobytes() + b"".join(w[:n].astype("<u2").tobytes() for w, n in zip(coder.words[lanes], words, strict=True))
            out.append(struct.pack("<4sIIII", MAGIC, len(docs), len(flat[k]), len(body), zlib.crc32(body)) + body)
    return out


def decode_blocks(payloads: list[bytes]) -> list[list[np.ndarray]]:
    """The documents' ids of every block; a damaged block raises ValueError."""
    out = []
    for at in range(0, len(payloads), TOGETHER):
        heads = []
        for p in payloads[at : at + TOGETHER]:
            magic, docs, n, size, crc = struct.unpack_from("<4sIIII", p)
            body = p[20 : 20 + size]
            if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
                raise ValueError("damaged block")
            lengths = np.frombuffer(body, "<u4", docs)
            words = np.frombuffer(body, "<u4", LANES, 4 * docs).astype(np.int64)
            heads.append((lengths, n, words, np.frombuffer(body, "<u2", int(words.sum()), 4 * docs + 4 * LANES)))
        sizes = [h[1] for h in heads]
        first, length = _shape(sizes)
        table = np.zeros((len(first), max(1, max(int(h[2].max()) for h in heads))), np.uint16)
        for k, (_, _, words, stream) in enumerate(heads):
            for lane, (a, n) in enumerate(zip(np.cumsum(words) - words, words, strict=True)):
                table[k * LANES + lane, :n] = stream[a : a + n]
        ids = _run(sizes, _Coder(len(first), 0, table), np.zeros((len(first), int(length.max(initial=0))), np.int64))
        for k, (lengths, _, _, _) in enumerate(heads):
            flat = np.concatenate([ids[k * LANES + lane, : length[k * LANES + lane]] for lane in range(LANES)])
            out.append(np.split(flat, np.cumsum(lengths.astype(np.int64))[:-1]) if len(lengths) else [])
    return out


def split_payload(payload: bytes) -> list[bytes]:
    """The blocks of a row."""
    out, at = [], 0
    while at < len(payload):
        if len(payload) < at + 20:
            raise ValueError("damaged block")
        size = 20 + struct.unpack_from("<4sIIII", payload, at)[3]
        out.append(payload[at : at + size])
        at += size
    return out


def encode_rows(rows: list[list[np.ndarray]]) -> list[bytes]:
    """Payloads of rows of documents' ids; a document of more than ``BLOCK_IDS`` ids is cut into blocks of its own."""
    blocks: list[list[np.ndarray]] = []
    number = []
    for docs in rows:
        own = [[docs[0][at : at + BLOCK_IDS]] for at in range(0, len(docs[0]), BLOCK_IDS)] if len(docs) == 1 and len(docs[0]) > BLOCK_IDS else [docs]
        blocks += own
        number.append(len(own))
    coded = iter(encode_blocks(blocks))
    return [b"".join(next(coded) for _ in range(n)) for n in number]


def decode_rows(payloads: list[bytes]) -> list[list[np.ndarray]]:
    """The documents' ids of every row; a damaged block raises ValueError."""
    cut = [split_payload(p) for p in payloads]
    back = iter(decode_blocks([b for blocks in cut for b in blocks]))
    rows = [[next(back) for _ in blocks] for blocks in cut]
    return [[np.concatenate([b[0] for b in blocks])] if len(blocks) > 1 else blocks[0] for blocks in rows]


def write_ids(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode all texts and write id files in ascending doc_id order; the table of rows, read back.

    Columns: part (in id order), block, doc_ids, n_ids, payload. A null text has
    the end id only. A null id sorts first. Repeated rows are written each, those
    of one id in the order of their texts' hashes, by several tasks if there are
    many. With ``path`` the files are written there and stay; else they are an
    intermediate table of the shared folder.
    """
    spark = docs.sparkSession
    # ranges of ids, so parts follow one another; the hash lets a very common id be split
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    texts = keyed_texts(docs, id_col, text_col).repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = library_tokenizer(tokenizer_file, True), TaskContext.get().partitionId()
        blocks: list[tuple[list, list[np.ndarray]]] = [([], [])]
        size, number, full = 0, 0, 0
        end = np.array([END_ID], "<u4")

        def flush() -> pa.RecordBatch:
            nonlocal number
            coded = encode_rows([b for _, b in blocks])
            rows = pa.record_batch(
                [
                    pa.array([part] * len(blocks), pa.int32()), pa.array(range(number, number + len(blocks)), pa.int32()), pa.array([k for k, _ in blocks], pa.list_(pa.int64())),
                    pa.array([sum(map(len, b)) for _, b in blocks], pa.int64()), pa.array(coded, pa.binary()),
                ],
                names=["part", "block", "doc_ids", "n_ids", "payload"],
            )
            number += len(blocks)
            return rows

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                keys, done = piece.column(0).to_pylist(), 0
                for group in groups_by_size([t.as_py() for t in piece.column(1)]):
                    for raw in tokenizer.encode(group):
                        ids = np.concatenate((np.frombuffer(raw, "<u4"), end))
                        if size and size + len(ids) > BLOCK_IDS:
                            full += max(1, -(-size // BLOCK_IDS))
                            if full >= TOGETHER:
                                yield flush()
                                blocks, full = [], 0
                            blocks.append(([], []))
                            size = 0
                        blocks[-1][0].append(keys[done])
                        blocks[-1][1].append(ids)
                        size += len(ids)
                        done += 1
        if blocks[-1][0]:
            yield flush()

    files = texts.mapInArrow(run, "part int, block int, doc_ids array<long>, n_ids long, payload binary")
    if path is None:
        return materialise(files, "id-files")
    files.write.parquet(path)
    return spark.read.schema(files.schema).parquet(path)


def read_ids(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document.

    ``files`` is what ``write_ids`` gives. A null id stays null, repeated ids are
    rows of their own, an empty table gives no rows, a damaged block raises an error.
    """
    spark = files.sparkSession
    parts = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row a part
    before = np.cumsum([0, *(r["n"] for r in parts)]).tolist()
    place = spark.createDataFrame([(r["part"], b) for r, b in zip(parts, before, strict=False)], "part int, base long")
    order = "sum(n_ids) OVER (PARTITION BY part ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = files.select("part", "block", F.coalesce(F.expr(order), F.lit(0)).alias("inside")).join(F.broadcast(place), "part").select("part", "block", (F.col("inside") + F.col("base")).alias("first"))
    rows = files.join(starts, ["part", "block"]).select("first", "doc_ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, start, n, crc, lists = [], [], [], [], []
            for (first, keys, _), docs in zip(waiting, decode_rows([w[2] for w in waiting]), strict=True):
                at = first
                for key, ids in zip(keys, docs, strict=True):
                    raw = ids.astype("<u4")
                    doc.append(key)
                    start.append(at)
                    n.append(len(raw))
                    crc.append(zlib.crc32(raw.tobytes()))
                    if with_ids:
                        lists.append(raw.astype(np.int32))
                    at += len(raw)
            cols = [pa.array(x, pa.int64()) for x in (doc, start, n, crc)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            return pa.record_batch(cols, names=names)

        for batch in batches:
            for first, keys, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                waiting.append((first.as_py(), keys.as_py(), payload.as_py()))
                size += len(waiting[-1][2])
                if len(waiting) >= TOGETHER or size >= TOGETHER * BLOCK_IDS:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
