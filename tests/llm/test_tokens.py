import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm.bpe import bpe_from_file, encode_digests, encode_documents
from weftline.llm import idfile
from weftline.llm.idfile import decode_blocks, decode_rows, encode_blocks, encode_rows, read_ids, write_ids
from weftline.llm.packing import CAPACITY, deal, differencing, pack
from weftline.llm.tokens import LibraryTokenizer, MergeTokenizer, byte_tokenizer, public_path

BYTE, WORD, RANKS = (public_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def odd_texts(n=3000):
    r = random.Random(1)
    chars = "abcdefghij ehtsrnio'éü中\U0001f600\x1c\x85　  \n\t 0123́ΣİSTIL²"
    return ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 3000, "=-" * 900, "", "<|endoftext|> x", "a<|endoftext|>b <|ENDOFTEXT|> c<|startoftext|>  d", "x " * 200 + "<|endoftext|>"]


def library(path):
    t = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("make, path", [(lambda: LibraryTokenizer(BYTE, False), BYTE), (lambda: LibraryTokenizer(WORD, True), WORD), (lambda: byte_tokenizer(BYTE), BYTE)])
def test_ids_are_those_of_the_library(make, path):
    texts = odd_texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in make().encode(texts)] == library(path)(texts)


def test_the_byte_vocabulary_merges_by_id():
    assert isinstance(byte_tokenizer(BYTE), MergeTokenizer)


def test_backtracking_gives_exact_merges_and_round_trips():
    import tiktoken

    bpe = bpe_from_file(RANKS)
    core = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=bpe.ranks, special_tokens={})
    for t in odd_texts():
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == core.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_every_pair_rule_agrees_with_plain_merging():
    bpe, r = bpe_from_file(RANKS), random.Random(3)
    for _ in range(300):
        data = bytes(r.choice(b"abcdethe ing\xc3\xa9\xff") for _ in range(r.randint(1, 12)))
        assert bpe.encode_piece(data) == ([bpe.ranks[data]] if data in bpe.ranks else bpe.merge(data))


def test_encode_documents(docs, texts, empty, odd_ids):
    got = {r.doc_id: r for r in encode_digests(docs, RANKS).collect()}
    bpe = bpe_from_file(RANKS)
    for i, t in enumerate(texts):
        ids = bpe.encode(t or "")
        assert got[i].n_tokens == len(ids) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_digests(empty, RANKS).count() == 0
    assert sorted(r.n_tokens for r in encode_digests(odd_ids, RANKS).collect()) == [0, 4, 4, 4]
    assert encode_documents(odd_ids, RANKS).count() == 4


def test_differencing_is_near_equal_and_fits():
    r = random.Random(2)
    for n in (1, 2, 7, 400):
        sizes = [r.randint(1, 512) for _ in range(n)]
        window, k = deal(sizes)
        sums = np.bincount(window, weights=sizes, minlength=k)
        assert sums.max() <= CAPACITY and len(window) == n
        assert k >= -(-sum(sizes) // CAPACITY)
    assert deal([]) [1] == 1
    # two windows: the classic two-way differencing result
    window = differencing([8, 7, 6, 5, 4], 2)
    sums = np.bincount(window, weights=[8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) == 2


def test_packing_places_every_id_once(docs, texts, empty, odd_ids):
    rows = pack(docs, BYTE).toPandas()
    encode = library(BYTE)
    want = {i: [*ids, 1] for i, ids in enumerate(encode([t or "" for t in texts]))}
    for doc, g in rows.sort_values("start").groupby("doc_id"):
        assert np.concatenate(g["ids"].tolist()).tolist() == want[doc]
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and (g["doc_tokens"] == len(want[doc])).all()
    assert set(rows["doc_id"]) == set(want)
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(rows["ids"], rows["ids_crc32"], strict=True))
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by["length"].sum().max() <= CAPACITY
    for _, g in by:
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert pack(empty, BYTE).count() == 0 and pack(odd_ids, BYTE).count() == 4


def test_block_coder_round_trips_and_finds_damage():
    rng = np.random.default_rng(0)
    for case in ([[np.array([1])]], [[]], [[np.array([5, 6, 7] * 100), np.array([1])], [rng.integers(0, 65536, 3000)]], [[np.zeros(0, int), np.array([3] * 5000)]]):
        back = decode_blocks(encode_blocks(case))
        assert [[d.tolist() for d in b] for b in back] == [[d.tolist() for d in b] for b in case]
    plain = encode_blocks([[rng.zipf(1.3, 20000) % 3000]])[0]
    assert len(plain) < 2 * 20000
    broken = bytearray(plain)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        decode_blocks([bytes(broken)])


def test_id_files(docs, texts, empty, odd_ids):
    files = write_ids(docs, WORD)
    rows = read_ids(files).toPandas().sort_values("start")
    want = [[*ids, 1] for ids in library(WORD)([t or "" for t in texts])]
    assert rows["doc_id"].tolist() == list(range(len(texts)))
    assert [list(x) for x in rows["ids"]] == want
    assert (rows["start"] == rows["n_tokens"].cumsum() - rows["n_tokens"]).all()
    assert read_ids(write_ids(empty, WORD)).count() == 0
    assert read_ids(write_ids(odd_ids, WORD), False).count() == 4


def test_long_documents_take_many_blocks(spark, monkeypatch, tmp_path):
    """Memory stays that of the usual blocks; files may be kept under a path."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows = [[rng.zipf(1.4, 700) % 3000 for _ in range(3)] for _ in range(40)]
    rows.insert(7, [rng.zipf(1.4, 400_000) % 3000])
    tracemalloc.start()
    coded = encode_rows(rows)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    assert [[d.tolist() for d in r] for r in decode_rows(coded)] == [[d.tolist() for d in r] for r in rows]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    with pytest.raises(ValueError):
        encode_blocks([[np.array([1 << 16])]])
    monkeypatch.setattr(idfile, "BLOCK_IDS", 100)
    df = spark.createDataFrame([(i, "many words of text " * (i % 5 * 40)) for i in range(20)], "doc_id long, text string")
    files = write_ids(df, WORD, path=str(tmp_path / "ids"))
    want = [[*ids, 1] for ids in library(WORD)(["many words of text " * (i % 5 * 40) for i in range(20)])]
    assert (tmp_path / "ids").exists() and [list(r.ids) for r in sorted(read_ids(files).collect(), key=lambda r: r.start)] == want
