import hashlib
import tarfile
import zlib

from pyspark.sql import Row

from curatrix.llm import media
from curatrix.llm.common import fresh_path


def payload(text):
    data = (text or "").encode()
    data += b"\xff" * (-len(data) % 576)
    return data or b"\xff" * 576


def test_round_trip_and_shards(spark, monkeypatch):
    texts = [None, "", "a" * 575, "a" * 576, "a" * 577, "é" * 700, "x" * 300_000, "same", "same"]
    rows = [Row(doc_id=k, text=t, offset="clash", Feature=1) for k, t in enumerate(texts)] + [Row(doc_id=None, text="same", offset=None, Feature=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, Feature int").repartition(3)
    folder = fresh_path(spark, "media-test")
    stored = media.store(df, folder)
    got = media.with_features(media.with_metadata(stored, folder), folder).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.text for r in rows}
    for r in got:
        want = payload(by_id[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256) == (len(want), hashlib.sha256(want).hexdigest())
        assert (r.n_bytes, r.tail_crc32) == (len((by_id[r.doc_id] or "").encode()), zlib.crc32(want[-32:]))
        assert (r.width, r.height, r.bits, r.feature) == (576, len(want) // 576, 8, media.feature_of(want))
        with tarfile.open(f"{folder.removeprefix('file://')}/{r.shard}") as tar:
            entry = tar.getmember(f"{r.media_sha256}.png")
            assert (entry.offset_data, entry.size) == (r.offset, r.length)
            assert media.from_png(tar.extractfile(entry).read()) == want
    assert media.with_features(media.store(df.limit(0), folder), folder).count() == 0


def test_damage_is_noticed():
    image = media.to_png(payload("hello"))
    assert media.from_png(image) == payload("hello")
    for at in (3, 20, 60):
        broken = image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :]
        try:
            media.from_png(broken)
        except (ValueError, zlib.error):
            continue
        raise AssertionError(at)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op10_media(spark, sf_dir).collect()
    assert {r.doc_id: r.payload_sha256 for r in got} == {k: hashlib.sha256(payload(t)).hexdigest() for k, t in docs.items()}
