"""Byte-level BPE encoding and decoding from a rank file, with exact merges.

A piece of text (a match of the pre-token pattern) is encoded without merging:
its bytes are read as Latin-1, one automaton pass finds every vocabulary entry
at every position, and tokens are laid from the left, the longest first. A token
may follow another only if the two are compatible, that is, if merging the bytes
of both gives back exactly these two tokens; the answer is remembered per pair.
Where no token fits, the last one is taken back and its next shorter rival tried;
a position once given up is never entered again, so the work is linear in the
piece. A sequence whose neighbours are all compatible is the one that merging by
rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts
from .tokens import BYTE_PATTERN, MAX_CACHED, MAX_PIECE, finder, groups_by_size, packed, shrink

MAX_PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_PATTERN):
        self.ranks = ranks
        self.find = finder(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank, used on the bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """left -1: whether the token can stand at all."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            want = [right] if left < 0 else [left, right]
            known = self.pairs[key] = self.merge(b"".join(self.tokens[t] for t in want)) == want
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (size, rank) in self.automaton.iter(data.decode("latin-1")):
            at[last - size + 1].append((size, rank))  # by rising end, so by rising length
        for options in at:
            options.reverse()
        open_at = bytearray(b"\x01") * (n + 1)
        laid: list[int] = []
        choice: list[int] = []  # which of its position's options each laid token is
        pos, k = 0, 0
        while pos < n:
            before = laid[-1] if laid else -1
            options = at[pos]
            while k < len(options):
                size, rank = options[k]
                if open_at[pos + size] and self.compatible(before, rank):
                    break
                k += 1
            if k < len(options):
                laid.append(rank)
                choice.append(k)
                pos, k = pos + size, 0
            else:
                if not laid:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_at[pos] = 0
                pos -= len(self.tokens[laid.pop()])
                k = choice.pop() + 1
        return laid

    def _missing(self, piece: str) -> bytes:
        return packed(self.encode_piece(piece.encode("utf-8", "replace")))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.find(text)
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        if len(cache) > MAX_CACHED:
            cache = self.cache = shrink(cache)
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self._missing(p)
                if len(p) <= MAX_PIECE:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def bpe_from_file(path: str) -> BacktrackingBPE:
    return BacktrackingBPE(read_ranks(path))


def encode_documents(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded text bytes (binary) of every document; no shuffle.

    Null and empty texts give no ids and no bytes. Null and repeated ids and
    other columns do no harm: rows are handled one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_from_file(rank_file)
        for ids, out in _encoded(batches, bpe):
            lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in out]
            yield pa.record_batch([ids, pa.array(lists, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in out], pa.binary())], names=["doc_id", "ids", "decoded"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _encoded(batches: Iterator[pa.RecordBatch], bpe: BacktrackingBPE) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Rows in groups of bounded text size."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 256)
            done = 0
            for group in groups_by_size([t.as_py() for t in part.column(1)]):
                yield part.column(0).slice(done, len(group)), [bpe.encode(t) for t in group]
                done += len(group)
            at += 256


def encode_digests(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode_documents`` with its outputs hashed where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_from_file(rank_file)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for ids, out in _encoded(batches, bpe):
            yield pa.record_batch(
                [ids, pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(map(sha, out), pa.string()), pa.array([sha(bpe.decode(x)) for x in out], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
