"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut: whole sequences first, the rest into
pieces of at most ``PIECE`` ids. The pieces of a block of neighbouring documents
are dealt to ``k`` windows: partial partitions, each a vector of ``k`` window
sums, are merged two at a time, those of the largest imbalance first, the
largest sum of one with the smallest of the other. ``k`` starts at the least
number of windows that can hold the block and rises while any window exceeds the
capacity. All windows of a block come out nearly equal, so padding is about half
a window a block.

Each Arrow partition is packed by itself in one pass: nothing is shuffled and
memory is bounded by a block. A block is a bounded number of pieces in row
order. A sequence id is the partition's number times 2**40 plus a running number
(unique and stable for the same files, not dense).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keyed_texts
from .tokens import groups_by_size, byte_tokenizer

CAPACITY = 2048
PIECE = 512
BLOCK_PIECES = 1500
END_ID = 1


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """Window (0..k-1) of each item, by multiway differencing into ``k`` windows.

    A partial partition is kept as its non-zero sums in falling order and, for
    each, the node of a merge tree; sums are taken relative to the smallest
    window once all ``k`` are in use.
    """
    n = len(sizes)
    left, right = [], []  # of tree nodes n, n + 1, ...
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, s1, t1 = heapq.heappop(heap)
        _, _, s2, t2 = heapq.heappop(heap)
        over = len(s1) + len(s2) - k
        if over <= 0:
            s, t = np.concatenate((s1, s2)), np.concatenate((t1, t2))
        else:
            # windows of the two in opposite order: only the last `over` of each share a window
            a, b = len(s1) - over, len(s2) - over
            joint = s1[a:] + s2[b:][::-1]
            nodes = np.arange(n + len(left), n + len(left) + over)
            left.extend(t1[a:].tolist())
            right.extend(t2[b:][::-1].tolist())
            s, t = np.concatenate((s1[:a], s2[:b], joint)), np.concatenate((t1[:a], t2[:b], nodes))
        order = np.argsort(-s, kind="stable")
        s, t = s[order], t[order]
        if len(s) == k:  # relative to the smallest window; that one stays, with sum zero
            s = s - s[-1]
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), tick, s, t))
        tick += 1
    window = np.zeros(n, np.int64)
    if not heap:
        return window
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += (left[x - n], right[x - n])
    return window


def deal(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Windows of the items and their number: the least for which no window exceeds the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        if not sizes or np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return window, k
        k += 1


def _packed(rows: Iterator[tuple[int | None, bytes]], capacity: int, piece: int, first_sequence: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, start, ids, doc_tokens, sequence_id, offset) for rows (doc_id, ids)."""
    waiting: list[tuple] = []
    sequence = first_sequence

    def flush() -> list[tuple]:
        nonlocal sequence, waiting
        window, k = deal([len(p[2]) // 4 for p in waiting], capacity)
        out, filled = [], [0] * k
        for w, (doc, start, ids, tokens) in zip(window.tolist(), waiting, strict=True):
            out.append((doc, start, ids, tokens, sequence + w, filled[w]))
            filled[w] += len(ids) // 4
        sequence += k
        waiting = []
        return out

    for doc, ids in rows:
        tokens = len(ids) // 4
        start, full = 0, []
        while tokens - start >= capacity:
            full.append((doc, start, ids[4 * start : 4 * (start + capacity)], tokens, sequence, 0))
            sequence += 1
            start += capacity
        if full:
            yield full
        if start < tokens:
            edges = [*range(start, tokens, piece), tokens]  # the odd last pieces are what lets differencing come out even
            waiting += [(doc, a, ids[4 * a : 4 * b], tokens) for a, b in zip(edges, edges[1:], strict=False)]
        if len(waiting) >= BLOCK_PIECES:
            yield flush()
    if waiting:
        yield flush()


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (array<int>, if asked for), ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id only. A null id stays null; repeated rows
    are packed each. An empty table gives no rows. Other columns are not read.
    """
    ids_type = ", ids array<int>" if with_ids else ""
    schema = f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{ids_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_tokenizer(tokenizer_file)
        end = np.array([END_ID], "<u4").tobytes()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keys, done = part.column(0).to_pylist(), 0
                    for group in groups_by_size([t.as_py() for t in part.column(1)]):
                        for ids in tokenizer.encode(group):
                            yield keys[done], ids + end
                            done += 1

        long = pa.int64()
        for out in _packed(rows(), capacity, piece, TaskContext.get().partitionId() << 40):
            doc, start, ids, tokens, seq, offset = zip(*out, strict=True)
            cols = [
                pa.array(doc, long), pa.array(start, long), pa.array([len(x) // 4 for x in ids], long), pa.array(map(zlib.crc32, ids), long),
                pa.array(tokens, long), pa.array(seq, long), pa.array(offset, long),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, schema)
