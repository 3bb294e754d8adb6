"""Packing and wavelet files against encoding each text at once."""

import random
import zlib

import numpy as np
import pytest

from cantorium.llm import packing, wavelet
from cantorium.llm.tokens import encoder, tokenizer_path

TEXTS = ["", None, "Hello, World!  it's <|endoftext|> <|ENDOFTEXT|>", "Y̊ ẞß éÉ Σς 中文", " \n\t ", "a " * 5000, "x" * 3000, "one two"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    return lambda text: known.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "no id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_encoder_equals_library(whole):
    pool = [*"abXYZéÉßİıΣςЖ中が̊̈ͅ   ​\x1c\x85\t\n.,;:!?'0٣²½Ⅷª", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "  "]
    rng, encode = random.Random(5), encoder()
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 20)))
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == whole(text), repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 1 << 13])
def test_cuts_cover_once_by_powers_of_two(n):
    pieces = packing.cuts(n)
    assert [a for a, _ in pieces] == [sum(m for _, m in pieces[:k]) for k in range(len(pieces))]
    assert sum(m for _, m in pieces) == n and all(m & (m - 1) == 0 and m <= 2048 for _, m in pieces)


def test_pack_round_trip(spark, docs, whole):
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    for i, text in enumerate(TEXTS):
        own = sorted((r.start, bytes(r.ids), r.doc_tokens) for r in rows if r.doc_id == i)
        ids = [*whole(text), 1]
        times = 2 if i == 3 else 1
        assert sorted(own) == sorted([(a, np.array(ids[a : a + m], "<u4").tobytes(), len(ids)) for a, m in packing.cuts(len(ids))] * times)
    assert sum(r.length for r in rows if r.doc_id is None) == len(whole("no id")) + 1


def test_buckets_have_folders_of_their_own(spark, docs, tmp_path):
    pieces = packing.pack(docs)
    laid = packing.write_buckets(pieces, str(tmp_path / "pieces"))
    own = lambda rows: sorted((r.doc_id or -1, r.start, bytes(r.ids), r.bucket) for r in rows)
    assert own(laid.collect()) == own(pieces.collect())
    some = laid.filter("bucket = 2")
    assert some.count()
    read = {r.f for r in some.selectExpr("input_file_name() as f").collect()}
    assert all("bucket=2/" in f for f in read) and all(r.length == 4 for r in some.collect())


def test_pack_empty(spark, docs):
    assert packing.pack(docs.limit(0)).collect() == []


def test_wavelet_matrix_answers(rng=np.random.default_rng(3)):
    for n in (0, 1, 7, 513, 3000):
        ids = rng.integers(0, 40, n)
        m = wavelet.WaveletMatrix.build(ids, 6)
        assert m.decode().tolist() == ids.tolist()
        assert [m.access(i) for i in range(min(n, 60))] == ids[:60].tolist()
        for token in (0, 5, 39, 63, 64):
            where = np.flatnonzero(ids == token).tolist()
            assert m.count(token) == len(where) and m.locate(token) == where
            assert m.rank(token, n // 2) == sum(x < n // 2 for x in where)


def test_shard_file_answers(rng=np.random.default_rng(4)):
    n = wavelet.BLOCK + 777
    ids = rng.integers(0, 49408, n)
    shard = wavelet.Shard(wavelet.Shard.dump([4, 9], [100, n - 100], ids))
    assert shard.decode().tolist() == ids.tolist() and shard.doc_ids.tolist() == [4, 9]
    token = int(ids[-1])
    assert shard.locate(token) == np.flatnonzero(ids == token).tolist() and shard.access(n - 1) == token
    assert shard.count(token) == int((ids == token).sum())
    where = np.flatnonzero(ids == token).tolist()
    assert [shard.select(token, k) for k in range(len(where))] == where
    assert [shard.rank(token, i) for i in (0, 5, wavelet.BLOCK, n - 1, n)] == [sum(w < i for w in where) for i in (0, 5, wavelet.BLOCK, n - 1, n)]
    for wrong in (-1, len(where)):
        with pytest.raises(IndexError):
            shard.select(token, wrong)
    one = wavelet.Shard(wavelet.Shard.dump([4, 9], [100, n - 100], ids))
    assert one.access(wavelet.BLOCK + 5) == ids[wavelet.BLOCK + 5] and list(one._opened) == [1]  # no other block was opened


def test_smallest_id_and_missing_ids(spark):
    low = -(1 << 63)
    docs = spark.createDataFrame([(low, "a"), (None, "b"), (0, "c"), (None, "d")], "doc_id long, text string").repartition(2)
    rows = sorted(wavelet.read_documents(wavelet.write_shards(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, low, 0]


def test_wavelet_round_trip(spark, docs, whole):
    rows = wavelet.read_documents(wavelet.write_shards(docs, shard_tokens=50)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7]
    at = 0
    for r in rows:
        ids = [*whole("no id" if r.doc_id is None else TEXTS[r.doc_id]), 1]
        assert r.start == at and zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_wavelet_empty(spark, docs):
    assert wavelet.read_documents(wavelet.write_shards(docs.limit(0))).collect() == []
