import hashlib
import random

import pytest
from pyspark.sql import Row

from curatrix.llm import piece_bpe

EDGES = [None, "", " ", "   ", "a", " a  b ", "It's  a\n\n test \t ▁x▁▁ ퟿ 日本語 \U0001f600", "é́ ﬁ Ａ ​x a\0b", "<0x0A></s><unk>", "x" * 50_000, "word " * 5000, "日本" * 20_000, " " * 20_001]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.MergeCodec.load(piece_bpe.default_model())


def encoded(codec, text):
    return [k for part in codec.parts.findall(piece_bpe.SPACE + text.replace(" ", piece_bpe.SPACE)) for k in codec.encode_part(part)] if text else []


def test_equals_library_on_random_texts(codec, library):
    rng = random.Random(7)
    alphabets = ["ab ", "aeiounthr ", "é€ß日本 a", "a", "\n\t ab", "▁ a", "the in on ation er", "0123 ", "\U0001f600a한국 ", "<0A>s/unk "]
    for _ in range(3000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([0, 1, 2, 5, 17, 60])))
        ids = encoded(codec, text)
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_decodes_any_ids_as_the_library(codec, library):
    rng = random.Random(8)
    for _ in range(3000):
        ids = [rng.randrange(1, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids)


def merged(text, score):
    parts = list(text)
    while True:
        joins = [(-score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not joins:
            return parts
        k = min(joins)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_backtracking_equals_merging_for_random_vocabularies():
    """Vocabularies where long matches are often wrong, pieces can't be reached, characters lack and scores tie."""
    rng = random.Random(9)
    for _ in range(300):
        words = {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        pieces = [("<unk>", 0.0, piece_bpe.UNKNOWN)] + [(w, float(rng.randrange(-8, 0)), piece_bpe.NORMAL) for w in sorted(words)]
        codec = piece_bpe.MergeCodec(pieces)
        for _ in range(20):
            text = "".join(rng.choices("abcd", k=rng.randrange(0, 30)))
            assert codec.pieces_of(text) == merged(text, codec.score)


def test_without_byte_pieces_characters_are_unknown():
    codec = piece_bpe.MergeCodec([("<unk>", 0.0, piece_bpe.UNKNOWN), ("a", -1.0, piece_bpe.NORMAL)])
    assert codec.encode_part("axa") == [1, 0, 1]
    assert piece_bpe.MergeCodec([]).pieces_of("ab") == ["a", "b"]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # trainer_spec { model_type: 1 }
    with pytest.raises(ValueError, match="merge type"):
        piece_bpe.MergeCodec.load(str(path))


def test_whole_texts_and_edge_cases(spark, library):
    rows = [Row(doc_id=k, text=t, piece_ids="clash", Decoded=1) for k, t in enumerate(EDGES)] + [Row(doc_id=4, text="a", piece_ids=None, Decoded=None), Row(doc_id=None, text="b", piece_ids=None, Decoded=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string, Decoded int")
    got = piece_bpe.encode_and_decode(df, piece_bpe.default_model()).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.piece_ids == library.encode(row.text or "")
        assert row.decoded == library.decode(row.piece_ids)
    assert piece_bpe.encode_and_decode(df.limit(0), piece_bpe.default_model()).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = piece_bpe.op12_piece_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_digest_of_no_ids(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    got = piece_bpe.digests(piece_bpe.encode_and_decode(df, piece_bpe.default_model())).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, empty, empty), (2, 0, empty, empty)]
