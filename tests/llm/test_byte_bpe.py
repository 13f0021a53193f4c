import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from curatrix.llm import byte_bpe


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.default_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library_on_random_pieces(reference):
    codec = byte_bpe.TreeCodec.load(byte_bpe.default_ranks()[0])
    rng = random.Random(1)
    for alphabet in ("ab", "aeiounthr", "é€ß日本", "a"):
        for size in (1, 2, 17, 40, 333, 3000):
            piece = "".join(rng.choice(alphabet) for _ in range(size))
            assert codec.encode_tree(piece.encode()) == reference.encode_ordinary(piece)


def test_whole_texts_and_edge_cases(spark, reference):
    texts = [None, "", " ", "a", "It's  a\n\n test   ퟿ 日本語 \U0001f600", "x" * 50_000, "word " * 5000, "\t\r\n 123 'll 'LL"]
    rows = [Row(doc_id=k, text=t, token_ids="clash", Decoded=1) for k, t in enumerate(texts)] + [Row(doc_id=3, text="a", token_ids=None, Decoded=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, Decoded int")
    got = byte_bpe.encode_and_decode(df, *byte_bpe.default_ranks()).collect()
    assert len(got) == len(rows)
    for row in got:
        assert np.frombuffer(bytes(row.token_ids), "<u4").tolist() == reference.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode_and_decode(df.limit(0), *byte_bpe.default_ranks()).count() == 0


def test_query(spark, sf_dir, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.op9_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(reference.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_leaves_side_by_side_equal_merging_one_by_one():
    codec, rng = byte_bpe.TreeCodec.load(byte_bpe.default_ranks()[0]), random.Random(2)
    leaves = ["".join(rng.choice("aeiounthré e") for _ in range(rng.randint(1, 16))).encode()[:16] for _ in range(10_000)]
    leaves += [bytes(rng.choice(b"aab\xc3\xa9\x80\xff\x00 10") for _ in range(rng.randint(1, 16))) for _ in range(10_000)] + [b"", b"a" * 16, b"\0" * 16]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge_many(leaves)] == [codec.merge(x) for x in leaves]


def test_pieces_in_use_outlive_a_full_cache(monkeypatch):
    codec = byte_bpe.TreeCodec.load(byte_bpe.default_ranks()[0])
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 40)
    cache, told = byte_bpe.PieceCache(codec), []
    many = codec.merge_many
    monkeypatch.setattr(codec, "merge_many", lambda leaves: told.extend(leaves) or many(leaves))
    for k in range(50):
        pieces = [" qqxzv", *[f"zz{k}q{j}" for j in range(10)]]
        assert cache.encode([pieces]) == [b"".join(np.array(codec.encode_piece(p.encode()), "<u4").tobytes() for p in pieces)]
    assert told.count(b" qqxzv") == 1
    assert len(cache.new) + len(cache.old) <= 4 * byte_bpe.CACHE_ENTRIES
