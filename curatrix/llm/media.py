"""Media columns: payloads in tar shards, addressed by content.

A document's text becomes 8-bit samples (UTF-8 bytes, padded with 255 up to a positive multiple of ROW samples) of a grey
PNG image. A task writes its images into tar shards in the shared folder, equal payloads once for each shard; rows carry
the shard, the stored image's SHA-256, its offset and length. Metadata columns are filled by range reads of the image's
header alone; features by range reads of the image.

A shard gets its final name when it is complete; a task that is run again writes shards of its own, and only shards named
in the staged rows are read. Results: null counts as empty, an empty text is ROW samples of 255; repeated rows each get a
row; an empty table gives none. Very long texts are images of many rows. Columns that have the name of a new one are
replaced, others of any name are kept.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import by_bytes, fresh_path, staged, table, trimmed, with_columns_from_batches, without

#: Samples of an image row.
ROW = 576
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 128 << 20
#: Bytes of stored images that a task reads back.
READ_BYTES = 16 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Magic, and the IHDR chunk with its length, name and checksum.
HEADER_BYTES = 33


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % ROW or (0 if data else ROW))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("no PNG header at this offset")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, bits = png_header(data[:HEADER_BYTES])
    at, parts = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        name, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if zlib.crc32(name + body) != int.from_bytes(crc, "big"):
            raise ValueError("a PNG chunk is damaged")
        if name == b"IDAT":
            parts.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are read")
    return lines[:, 1:].tobytes()


class ShardWriter:
    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.tar = None

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        """Shard, SHA-256, offset and length of the stored image; a payload that the shard has already is not stored again."""
        if self.tar is None:
            self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.root}/_{self.name}", compression=None)
            self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)
        key = hashlib.sha256(payload).digest()
        if key not in self.known:
            image = to_png(payload)
            digest = hashlib.sha256(image).hexdigest()
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(image)
            self.tar.addfile(entry, io.BytesIO(image))
            self.known[key] = (self.name, digest, self.at + tarfile.BLOCKSIZE, len(image))
            self.at += tarfile.BLOCKSIZE + -(-len(image) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
        found = self.known[key]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.out.close()
            self.fs.move(f"{self.root}/_{self.name}", f"{self.root}/{self.name}")
            self.tar = None


class ShardReader:
    """Range reads; the file that was read last stays open."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def store(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Writes the payloads of `text` to shards in folder. Returns, staged, the other columns of docs and n_bytes, shard, media_sha256, offset, length."""
    new = ["n_bytes", "shard", "media_sha256", "offset", "length"]
    keep = without(docs, [*new, text])
    names = keep.columns
    schema = T.StructType([*keep.schema.fields, *T._parse_datatype_string("n_bytes long, shard string, media_sha256 string, offset long, length long").fields])
    marked = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for whole in batches:
            for batch in by_bytes(whole):
                rows = []
                for value in batch.column(len(names)):
                    data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                    rows.append((len(data), *writer.add(padded(data))))
                cells = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(x, k) for x, k in zip(cells, kinds, strict=True)]], names=[*names, *new])
        writer.close()

    return staged(marked.mapInArrow(trimmed(run), schema), "media-rows")


def by_place(rows: DataFrame) -> DataFrame:
    """rows dealt out by shard and offset, READ_BYTES of stored images to a task: the rows' own size says nothing about theirs."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-total // READ_BYTES)), "shard", "offset", *[F.xxhash64(c) for c in rows.columns if c in ("doc_id",)])


def with_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Appends media_type, width, height and bits, from the images' headers alone."""

    def make() -> Callable:
        reader = ShardReader(folder)

        def step(shard: pa.Array, offset: pa.Array) -> list[pa.Array]:
            heads = [png_header(reader.read(s.as_py(), o.as_py(), HEADER_BYTES)) for s, o in zip(shard, offset, strict=True)]
            cells = zip(*heads, strict=True) if heads else [[]] * 3
            return [pa.array(["image/png"] * len(heads), pa.string()), *[pa.array(x, pa.int64()) for x in cells]]

        return step

    fields = T._parse_datatype_string("media_type string, width long, height long, bits long").fields
    return with_columns_from_batches(rows, ["shard", "offset"], make, fields)


def feature_of(payload: bytes) -> str:
    """Counts that describe the samples: rows, sum, distinct values, changes from sample to sample, and a histogram of eight bins."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"rows={len(x) // ROW};sum={int(x.sum(dtype=np.int64))};distinct={len(np.unique(x))};changes={int((x[1:] != x[:-1]).sum())};hist={','.join(map(str, bins))}"


def with_features(rows: DataFrame, folder: str) -> DataFrame:
    """Appends payload_bytes, payload_sha256, tail_crc32, media_bytes and feature, from the stored images; checks the images' digests."""

    def make() -> Callable:
        reader, last = ShardReader(folder), {}

        def features(shard: str, digest: str, offset: int, length: int) -> tuple:
            if digest not in last:
                media = reader.read(shard, offset, length)
                if hashlib.sha256(media).hexdigest() != digest:
                    raise ValueError(f"{shard} does not hold {digest} at {offset}")
                payload = from_png(media)
                if len(last) >= 256:
                    last.clear()
                last[digest] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), feature_of(payload))
            return last[digest]

        def step(*cells: pa.Array) -> list[pa.Array]:
            found = [features(*(v.as_py() for v in row)) for row in zip(*cells, strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return [pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)]

        return step

    fields = T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string").fields
    return with_columns_from_batches(rows, ["shard", "media_sha256", "offset", "length"], make, fields)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "media")
    rows = store(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    found = with_features(with_metadata(by_place(rows), folder), folder)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "width", "height", "bits")
