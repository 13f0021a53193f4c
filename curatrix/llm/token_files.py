"""Token ids in binary files, coded by an adaptive context-mixing range coder.

A file holds blocks of BLOCK_IDS ids. Every block starts from the same fresh model and has a checksum of its own, so any
block can be read alone. For each id the model asks, in turn:

* is it the id that followed the last two ids (order 2)? is it the id that followed the last one (order 1)? The
  probability of yes mixes two adaptive counters, one for each order's record so far, with weights that move towards the
  counter that was right;
* else its high and its low byte, from adaptive order-0 counts (low bytes: by class of the high byte).

The answers drive a range coder with 16-bit probabilities. All blocks of a file are coded side by side, one id of each at
a time, so the work is array operations over blocks. The arithmetic is of integers only: any machine reads what any other
wrote.

Results: a null text counts as empty; each document ends with the end id. Documents are ordered by id (null ids first;
repeated ids by a hash of the text). Ids must be below 65,536.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import fresh_path, staged, table, trimmed

BLOCK_IDS = 4096
#: A file is closed once it holds so many ids; so many of its blocks are coded side by side.
FILE_IDS, LANES = 8_000_000, 768
END_ID = 1
_MAGIC = b"CTXTOK01"
_U = np.uint64
_BASE1, _BASE2 = 1 << 11, 1 << 12  # slots of the order-1 and order-2 tables
_RATE = 5


class Model:
    """The adaptive model of `lanes` blocks at once."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        self.row1, self.row2 = self.lanes * _BASE1, self.lanes * _BASE2
        self.next1, self.sure1 = np.zeros(lanes * _BASE1, np.uint16), np.zeros(lanes * _BASE1, np.int8)
        self.next2, self.sure2 = np.zeros(lanes * _BASE2, np.uint16), np.zeros(lanes * _BASE2, np.int8)
        # yes-probabilities by record: of order 2, and of the other order (8 records, and whether both name one id)
        self.own = np.full((2, lanes * 8), 1 << 14, np.int64)
        self.other = np.full((2, lanes * 16), 1 << 14, np.int64)
        self.weight = np.full((2, lanes), 128, np.int64)
        self.high, self.low = Digits(lanes, 256, 1), Digits(lanes, 256, 3)
        self.row8, self.row16 = self.lanes * 8, self.lanes * 16
        self.a = self.b = np.zeros(lanes, np.int64)  # the last two ids
        self.done = 0

    def predict(self) -> None:
        self.at1 = self.row1 + ((self.b * 40503 >> 4) & (_BASE1 - 1))
        self.at2 = self.row2 + ((self.a * 30011 + self.b * 46349 >> 3) & (_BASE2 - 1))
        self.guess1, self.guess2 = self.next1[self.at1], self.next2[self.at2]
        record1, record2 = self.sure1[self.at1], self.sure2[self.at2]
        same = self.guess1 == self.guess2
        self.slots = ((self.row8 + record2, self.row16 + record1 + 8 * same), (self.row8 + record1, self.row16 + record2 + 8 * same))

    def chance(self, k: int) -> np.ndarray:
        """The mixed probability of yes to question k, of 65,536."""
        i, j = self.slots[k]
        self.p, self.q = self.own[k][i], self.other[k][j]
        return np.clip((self.p * self.weight[k] + self.q * (256 - self.weight[k])) >> 8, 64, 65472)

    def learn(self, k: int, yes: np.ndarray, asked: np.ndarray | None) -> None:
        i, j = self.slots[k]
        goal = yes.astype(np.int64) * 65535
        off_p, off_q = goal - self.p, goal - self.q
        better = np.sign(np.abs(off_q) - np.abs(off_p)) * 2
        if asked is not None:
            off_p, off_q, better = off_p * asked, off_q * asked, better * asked
        self.own[k][i] = self.p + (off_p >> _RATE)
        self.other[k][j] = self.q + (off_q >> _RATE)
        self.weight[k] = np.clip(self.weight[k] + better, 8, 248)

    def follow(self, ids: np.ndarray, told: np.ndarray) -> None:
        """Takes in the id of each block; told: where the digits were coded."""
        for guess, following, sure, at in ((self.guess1, self.next1, self.sure1, self.at1), (self.guess2, self.next2, self.sure2, self.at2)):
            hit = guess == ids
            record = sure[at]
            sure[at] = np.where(hit, np.minimum(record + 1, 7), np.where(record > 1, record >> 1, 0))
            following[at] = np.where(hit | (record < 2), ids, guess)
        self.high.learn(ids >> 8, 0, told)
        self.low.learn(ids & 255, np.minimum(ids >> 8, 2), told)
        self.done += 1
        if self.done in (8, 32, 96, 224) or self.done % 256 == 0:
            self.high.rebuild()
            self.low.rebuild()
        self.a, self.b = self.b, ids


class Digits:
    """Adaptive frequencies of digits, in `classes` tables for each block; 12-bit probabilities are renewed now and then."""

    def __init__(self, lanes: int, size: int, classes: int):
        self.shape, self.row = (lanes * classes, size), np.arange(lanes) * classes
        self.counts = np.ones(self.shape, np.int32).reshape(-1)
        self.size = size
        self.rebuild()

    def rebuild(self) -> None:
        counts = self.counts.reshape(self.shape).astype(np.int64)
        freq = 1 + counts * (4096 - self.size) // counts.sum(axis=1, keepdims=True)
        freq[:, 0] += 4096 - freq.sum(axis=1)
        self.freq = freq.reshape(-1).astype(np.int32)
        self.start = (np.cumsum(freq, axis=1) - freq).reshape(-1).astype(np.int32)
        self.inverse = np.repeat(np.tile(np.arange(self.size, dtype=np.uint8), self.shape[0]), self.freq)

    def span(self, digit: np.ndarray, cls: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        at = (self.row + cls) * self.size + digit
        return self.start[at] << 4, self.freq[at] << 4

    def digit(self, value: np.ndarray, cls: np.ndarray | int) -> np.ndarray:
        return self.inverse[((self.row + cls) << 12) + (value >> 4)].astype(np.int64)

    def learn(self, digit: np.ndarray, cls: np.ndarray | int, told: np.ndarray) -> None:
        self.counts[(self.row + cls) * self.size + digit] += told * 24


class Encoder:
    """Range coders side by side: 48-bit ranges, 16-bit words. Words may hold a carry until finish() passes it on."""

    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
        self.words = np.zeros((lanes, 3 * ids + 8), np.uint32)
        self.count = np.zeros(lanes, np.int64)
        self.lanes = np.arange(lanes)

    def put(self, start: np.ndarray, freq: np.ndarray) -> None:
        unit = self.range >> _U(16)
        self.low += unit * start.astype(_U)
        self.range = unit * freq.astype(_U)
        short = np.flatnonzero(self.range < _U(1 << 32))
        if len(short):
            low = self.low[short]
            self.words[short, self.count[short]] = low >> _U(32)
            self.count[short] += 1
            self.low[short] = (low & _U(0xFFFFFFFF)) << _U(16)
            self.range[short] <<= _U(16)

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.words[self.lanes, self.count] = (self.low >> _U(shift)).astype(np.uint32) & np.uint32(0xFFFF if shift != 32 else 0x1FFFF)
            self.count += 1
        words, carry = self.words.astype(np.int64), np.zeros(len(self.lanes), np.int64)
        for k in range(int(self.count.max(initial=0)) - 1, -1, -1):
            total = words[:, k] + carry
            carry = total >> 16
            words[:, k] = total & 0xFFFF
        words = words.astype("<u2")
        return [words[k, :n].tobytes() for k, n in enumerate(self.count)]


class Decoder:
    def __init__(self, blocks: list[bytes]):
        longest = max(len(b) for b in blocks) // 2 + 4
        self.words = np.zeros((len(blocks), longest), np.uint16)
        for k, b in enumerate(blocks):
            self.words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
        w = self.words.astype(_U)
        self.code, self.range = (w[:, 0] << _U(32)) | (w[:, 1] << _U(16)) | w[:, 2], np.full(len(blocks), 1 << 48, _U)
        self.at = np.full(len(blocks), 3, np.int64)

    def value(self) -> np.ndarray:
        self.unit = self.range >> _U(16)
        return np.minimum(self.code // self.unit, _U(65535)).astype(np.int64)

    def take(self, start: np.ndarray, freq: np.ndarray) -> None:
        self.code -= self.unit * start.astype(_U)
        self.range = self.unit * freq.astype(_U)
        short = np.flatnonzero(self.range < _U(1 << 32))
        if len(short):
            self.code[short] = (self.code[short] << _U(16)) | self.words[short, np.minimum(self.at[short], self.words.shape[1] - 1)]
            self.at[short] += 1
            self.range[short] <<= _U(16)


_ALL = 65536


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """ids: uint16, blocks by positions. Every block is coded by itself."""
    lanes, length = ids.shape
    model, coder = Model(lanes), Encoder(lanes, length)
    for k in range(length):
        x = ids[:, k].astype(np.int64)
        model.predict()
        p, yes2 = model.chance(0), model.guess2 == x
        coder.put(np.where(yes2, 0, p), np.where(yes2, p, _ALL - p))
        model.learn(0, yes2, None)
        asked = ~yes2 & (model.guess1 != model.guess2)
        p, yes1 = model.chance(1), model.guess1 == x
        coder.put(np.where(asked & ~yes1, p, 0), np.where(asked, np.where(yes1, p, _ALL - p), _ALL))
        model.learn(1, yes1, asked)
        told = ~yes2 & ~(asked & yes1)
        for digits, digit, cls in ((model.high, x >> 8, 0), (model.low, x & 255, np.minimum(x >> 8, 2))):
            start, freq = digits.span(digit, cls)
            coder.put(start * told, np.where(told, freq, _ALL))
        model.follow(x, told)
    return coder.finish()


def decode_blocks(blocks: list[bytes], length: int) -> np.ndarray:
    out = np.empty((len(blocks), length), np.uint16)
    if not blocks:
        return out
    model, coder = Model(len(blocks)), Decoder(blocks)
    for k in range(length):
        model.predict()
        p = model.chance(0)
        yes2 = coder.value() < p
        coder.take(np.where(yes2, 0, p), np.where(yes2, p, _ALL - p))
        model.learn(0, yes2, None)
        asked = ~yes2 & (model.guess1 != model.guess2)
        p = model.chance(1)
        yes1 = coder.value() < p
        coder.take(np.where(asked & ~yes1, p, 0), np.where(asked, np.where(yes1, p, _ALL - p), _ALL))
        model.learn(1, np.where(asked, yes1, model.guess1 == model.guess2), asked)
        told = ~yes2 & ~(asked & yes1)
        value = coder.value()
        high = model.high.digit(value, 0) * told
        start, freq = model.high.span(high, 0)
        coder.take(start * told, np.where(told, freq, _ALL))
        cls = np.minimum(high, 2)
        low = model.low.digit(coder.value(), cls) * told
        start, freq = model.low.span(low, cls)
        coder.take(start * told, np.where(told, freq, _ALL))
        x = np.where(told, high << 8 | low, np.where(yes2, model.guess2, model.guess1)).astype(np.int64)
        model.follow(x, told)
        out[:, k] = x
    return out


def to_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """Header, documents (present, id, length), blocks (bytes, ids, crc32 of the ids), then the blocks' words."""
    full = len(ids) // BLOCK_IDS
    blocks = ids[: full * BLOCK_IDS].reshape(full, BLOCK_IDS)
    parts = [p for k in range(0, full, LANES) for p in encode_blocks(blocks[k : k + LANES])]
    if full * BLOCK_IDS < len(ids):
        parts += encode_blocks(ids[full * BLOCK_IDS :][None, :])
    sizes = [BLOCK_IDS] * full + ([len(ids) % BLOCK_IDS] if len(ids) % BLOCK_IDS else [])
    table = b"".join(struct.pack("<III", len(p), n, zlib.crc32(ids[k * BLOCK_IDS : k * BLOCK_IDS + n].astype("<u2").tobytes())) for k, (p, n) in enumerate(zip(parts, sizes, strict=True)))
    docs = np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    head = _MAGIC + struct.pack("<QQQ", len(ids), len(doc_ids), len(parts))
    return b"".join([head, struct.pack("<I", zlib.crc32(head + docs + table)), docs, table, *parts])


def from_file(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, and the documents' ids and lengths. Raises if a checksum doesn't hold."""
    if data[:8] != _MAGIC:
        raise ValueError("not a token file")
    n, docs, blocks = struct.unpack("<QQQ", data[8:32])
    at = 36 + 13 * docs
    if zlib.crc32(data[:32] + data[36 : at + 12 * blocks]) != struct.unpack("<I", data[32:36])[0]:
        raise ValueError("the header is damaged")
    there = np.frombuffer(data, "u1", docs, 36)
    ids_of = np.frombuffer(data, "<i8", docs, 36 + docs)
    lengths = np.frombuffer(data, "<u4", docs, 36 + 9 * docs).astype(np.int64)
    table = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * blocks
    parts = []
    for size in table[:, 0]:
        parts.append(data[at : at + size])
        at += size
    full = n // BLOCK_IDS
    out = [decode_blocks(parts[k : min(full, k + LANES)], BLOCK_IDS).reshape(-1) for k in range(0, full, LANES)]
    if len(parts) > full:
        out.append(decode_blocks(parts[full:], int(table[-1, 1])).reshape(-1))
    ids = np.concatenate(out) if out else np.empty(0, np.uint16)
    for k, crc in enumerate(table[:, 2]):
        if zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return ids, [int(d) if t else None for t, d in zip(there, ids_of, strict=True)], lengths


_encoders: dict[str, Callable[[str], bytes]] = {}
#: Words of the tokenizer's cache of a Python worker; when full it starts anew.
CACHE_ENTRIES = 200_000


def word_encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as 16-bit integers, by the tokenizers library.

    Its normalizer, its pre-tokenizer and its search for added tokens (such as an end of text that a text spells out) work
    inside what blanks and line ends separate, so the library encodes each such word once and its ids are kept.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer, cache = Tokenizer.from_file(path), {}
        # added tokens are found before anything else; where one could reach beyond a word, texts that hold its content go whole
        wide = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.lstrip or t.rstrip or re.search(r"\s", t.content)]

        def encode(text: str) -> bytes:
            if any(t in text for t in wide):
                return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            words = text.replace("\n", " ").split(" ")
            found = [cache.get(w) for w in words]
            if None in found:
                new = list({w for w, f in zip(words, found, strict=True) if f is None})
                made = {w: np.array(e.ids, "<u2").tobytes() for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
                found = [made[w] if f is None else f for w, f in zip(words, found, strict=True)]
                if len(cache) + len(made) > CACHE_ENTRIES:
                    cache.clear()
                cache.update((w, ids) for w, ids in made.items() if len(w) <= 64)
            return b"".join(found)

        _encoders[path] = encode
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of documents (doc_id, text) to files in folder, in order of ids. Returns the staged list of files: part, seq, path, n_ids."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode, end = word_encoder(tokenizer_path), np.array([end_id], "<u2").tobytes()
        part, done = TaskContext.get().partitionId(), []
        ids, keys, lengths, held = [], [], [], 0

        def write() -> None:
            name = f"tokens-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.bin"
            joined = np.frombuffer(b"".join(ids), "<u2")
            with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
                out.write(to_file(joined, keys, lengths))
            store.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((part, len(done), name, len(joined)))

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                data = encode(value.as_py() or "") + end
                ids.append(data)
                keys.append(key.as_py())
                lengths.append(len(data) // 2)
                held += len(data) // 2
                if held >= FILE_IDS:
                    write()
                    ids, keys, lengths, held = [], [], [], 0
        if keys:
            write()
        cells = zip(*done, strict=True) if done else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], names=["part", "seq", "path", "n_ids"])

    return staged(ordered.mapInArrow(trimmed(run), "part int, seq int, path string, n_ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the files; ids as little-endian unsigned 32-bit integers."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.withColumn("first", before)  # one row for a file of millions of ids
    spread = listed.repartition(max(1, min(files.count(), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column(0), batch.column(1), strict=True):
                with store.open_input_file(f"{root}/{path.as_py()}") as file:
                    ids, keys, lengths = from_file(file.read())
                ends = np.cumsum(lengths)
                for at in range(0, len(keys), 2000):
                    stop = min(len(keys), at + 2000)
                    values = [ids[ends[k] - lengths[k] : ends[k]].astype("<u4").tobytes() for k in range(at, stop)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at:stop], pa.int64()), pa.array(first.as_py() + (ends - lengths)[at:stop], pa.int64()), pa.array(lengths[at:stop], pa.int64()), pa.array(values, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return spread.select("path", "first").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
