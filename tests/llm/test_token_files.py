import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from curatrix.llm import token_files
from curatrix.llm.common import fresh_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(tokenizer, rows):
    """rows: (doc_id, text) in order of ids."""
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 65536, 9000), np.zeros(10_000, int), rng.integers(0, 3, 20_000), np.arange(12_345), np.array([], int), np.array([65535])):
        ids = ids.astype(np.uint16)
        data = token_files.to_file(ids, [4, None], [1, max(0, len(ids) - 1)])
        back, keys, lengths = token_files.from_file(data)
        assert (back == ids).all() and keys == [4, None] and lengths.tolist() == [1, max(0, len(ids) - 1)]
    repeated = np.tile(rng.integers(0, 49_000, 50), 400).astype(np.uint16)
    assert len(token_files.to_file(repeated, [], [])) < 0.25 * 2 * len(repeated)


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(2).integers(0, 500, 3 * token_files.BLOCK_IDS).astype(np.uint16)
    blocks = ids.reshape(3, -1)
    together = token_files.encode_blocks(blocks)
    assert together[1] == token_files.encode_blocks(blocks[1:2])[0]
    data = bytearray(token_files.to_file(ids, [1], [len(ids)]))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.from_file(bytes(data))


def test_words_are_encoded_as_the_library_does(tokenizer):
    import public_tokenizers

    encode = token_files.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", " ", "It's 'tis  x's\n\nNEW\tline\r\n", "é ́a ΑΣ ΑΣ. ΣΑ", "<|endoftext|> a<|startoftext|>b", "x <|endoftext|> y", "x<|endoftext|>y", "<|endoftext|><|startoftext|>", "a<|endoftext|", "Don't<|endoftext|>'s 's<|startoftext|> 12<|endoftext|>3", "<|ENDOFTEXT|>", "\x1c\x1d a b c　d", "日本 123 4٣ ½", "\U0001f600" * 40, "İI ß ſ ffi"):
        assert np.frombuffer(encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_and_edge_cases(spark, tokenizer, monkeypatch):
    import public_tokenizers

    texts = ["b c", None, "", "A b, c!", "word " * 9000, "A b, c!"]
    rows = [Row(doc_id=k * 7 % 11, text=t, start="clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = fresh_path(spark, "tokens-test")
    files = token_files.write_tokens(df, folder, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_files.read_tokens(files, folder).collect())
    assert got == brute(tokenizer, sorted((r.doc_id, r.text) for r in rows))
    odd = spark.createDataFrame([(None, "x"), (None, None), (2, "y"), (2, "y")], "doc_id long, text string")
    files = token_files.write_tokens(odd, folder, public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_tokens(files, folder).collect()
    assert sorted(r.start for r in got) == [0, *sorted(np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)]).tolist())[:-1]]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 2, 2]
    files = token_files.write_tokens(odd.limit(0), folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(files, folder).count() == 0


def test_query(spark, sf_dir, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(tuple(r) for r in token_files.op2_token_files(spark, sf_dir).collect()) == brute(tokenizer, docs)
