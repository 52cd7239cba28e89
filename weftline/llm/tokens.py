"""Ids of public tokenizers, through a bounded cache of pre-tokens.

Pre-token patterns split a text into pieces that are encoded one by one, so the
ids of a text are the ids of its pieces in order. A worker keeps the ids of
pieces it has met, as bytes; new pieces go to the tokenizer library in one batch.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import regex

#: Pre-token pattern of the byte-level vocabularies (fixed value, as published with them).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-token pattern of the word-end vocabulary (fixed value, as published with it).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
MAX_PIECE = 48
MAX_CACHED = 400_000
#: Characters of text that are split at once.
SLICE = 400_000
#: Below this code point letters and numbers are spelled out for the standard library's matcher, which is twice as fast.
PLAIN = 0x250


def _ranges(kind: str) -> str:
    """The characters below PLAIN whose general category begins with ``kind``, as the inside of a character class."""
    points = [c for c in range(PLAIN) if unicodedata.category(chr(c)).startswith(kind)]
    starts = [c for c in points if c - 1 not in points]
    ends = [c for c in points if c + 1 not in points]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def finder(pattern: str):
    r"""``findall`` of a pre-token pattern; ``\\s`` is Unicode white space, as in the tokenizer libraries."""
    unicode = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")).findall
    space = r"\t-\r\x20\x85\xa0"
    own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{_ranges('L')}{_ranges('N')}]").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    own = own.replace(r"[\p{L}]", f"[{_ranges('L')}]").replace(r"[\p{N}]", f"[{_ranges('N')}]").replace(r"\p{L}", f"[{_ranges('L')}]").replace(r"\p{N}", f"[{_ranges('N')}]")
    plain, beyond = re.compile(own).findall, re.compile(f"[^\\x00-{chr(PLAIN - 1)}]").search

    def find(text: str) -> list[str]:
        return unicode(text) if beyond(text) else plain(text)

    return find


def shrink(cache: dict) -> dict:
    """The half of a full cache that was met first, which holds the common pieces."""
    return dict(islice(cache.items(), len(cache) // 2))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class LibraryTokenizer:
    """Ids by the ``tokenizers`` library from a vocabulary file, as its ``encode`` gives them without added tokens.

    A text that holds the string of a special token (which the library turns
    into that token) goes to the library whole; with ``plain`` such strings are ordinary text.
    """

    def __init__(self, path: str, words: bool, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, special))).search if special and not plain else lambda text: None
        self.words = words
        self.find = finder(WORD_PATTERN if words else BYTE_PATTERN)
        self.cache: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        if not self.words:
            return text
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # the library lower-cases single characters: no final sigma

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text: its ids as little-endian unsigned 32-bit integers."""
        out = []
        for group in groups_by_size(texts):
            whole = {k: packed(self.library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(group) if self.special(t)}
            pieces = [() if k in whole else self.find(self.normal(t)) for k, t in enumerate(group)]
            cache = self.cache
            new = set().union(*pieces).difference(cache)
            if len(cache) + len(new) > MAX_CACHED:
                cache = self.cache = shrink(cache)
                new = set().union(*pieces).difference(cache)
            if new:
                order = list(new)
                for p, e in zip(order, self.library.encode_batch_fast(order, add_special_tokens=False), strict=True):
                    cache[p] = packed(e.ids)
            get = cache.__getitem__
            out += [whole[k] if k in whole else b"".join(map(get, ps)) for k, ps in enumerate(pieces)]
            for p in [p for p in new if len(p) > MAX_PIECE]:
                del cache[p]
        return out


def groups_by_size(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``SLICE`` characters together; a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > SLICE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


LONG_RUN = re.compile(r"\S{1000}|\s{1000}").search


class MergeTokenizer:
    """The same ids as ``LibraryTokenizer`` for byte-level vocabularies whose ids are their merge order.

    The vocabulary file's own tokens and ids are given as ranks to tiktoken's
    core, which is about four times as fast on texts of rare words. Texts with
    a very long run without a break, on which that core is slow, go to the
    library.
    """

    def __init__(self, path: str, ranks: dict[bytes, int]):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = LibraryTokenizer(path, False)

    def encode(self, texts: list[str]) -> list[bytes]:
        fast = self.core.encode_to_numpy
        return [self.library.encode([t])[0] if LONG_RUN(t) or self.library.special(t) else fast(t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level file if merging by least id is merging in its order, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or model.get("ignore_merges"):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173 and (b < 127 or b > 160)]
    spelled = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab["".join(p)] for p in pairs]
    special = {t["content"] for t in spec["added_tokens"]}
    plain = {t: i for t, i in vocab.items() if t not in special}
    if ids != sorted(set(ids)) or len(pairs) + 256 != len(plain) or any(c not in spelled for t in plain for c in t):
        return None
    return {bytes(spelled[c] for c in t): i for t, i in plain.items()}


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> MergeTokenizer | LibraryTokenizer:
    ranks = merge_ranks(path)
    return MergeTokenizer(path, ranks) if ranks else LibraryTokenizer(path, False)


@lru_cache(maxsize=4)
def library_tokenizer(path: str, words: bool = False) -> LibraryTokenizer:
    """One for each worker and file."""
    return LibraryTokenizer(path, words)
