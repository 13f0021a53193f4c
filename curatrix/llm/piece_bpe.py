"""SentencePiece merge-type encoding and decoding, exact, by backtracking.

A merge-type vocabulary joins the neighbours of highest score until none are left. A sequence of pieces is the encoding of
its text exactly if every two neighbours are the encoding of their own text: before the first merge over a boundary, the
pieces on its sides have merged as they would alone. So the encoding is found left to right. An Aho-Corasick automaton
tells the longest piece that begins at each place; it is taken if merging it anew together with its predecessor gives the
two back, else the next shorter one is tried; where none fits, the place is marked in a bitfield as failed and the piece
before it is shortened. A place is reached by one valid sequence at most, so each is left at most once, and time is about linear.

Texts are cut, before that, where no piece of the vocabulary reaches across; the parts are cached by a Python worker.

Results: a null text counts as empty; an empty text has no ids and decodes to an empty one. Very long texts, and very long
runs without a cut, are encoded whole. An empty table gives no rows, repeated rows each get theirs. Columns that have the
name of a new one (piece_ids, decoded) are replaced, others of any name are kept. A model of another type, with a normaliser
table, or with user-defined or unused pieces raises ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import table, with_columns_from_batches

#: What a space becomes (fixed value), and what unknown ids decode to (fixed value).
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: No piece.
NONE = -1
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of a Python worker's cache of neighbours, which starts anew when full, and of each of its two generations of encoded parts.
CACHE_ENTRIES = 600_000
#: Parts up to so many characters are cached.
CACHED_PART = 48


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message: varints as integers, other values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class MergeCodec:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        """pieces: (text, score, kind) of each id."""
        self.texts = [p for p, _, _ in pieces]
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: score for p, score, kind in pieces if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            if len(p) > 1:  # any character may stand alone
                self.automaton.add_word(p, k)
        if len(self.automaton):
            self.automaton.make_automaton()
        # a code is a piece's id, or, beyond the ids, a character that is no piece
        self.sizes = list(map(len, self.texts))
        self.shorter = [NONE] * len(pieces)
        for p, k in self.ids.items():
            if len(p) > 1:
                self.shorter[k] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), len(pieces) + ord(p[0]))
        plain = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), CONTROL: lambda p: b""}
        self.bytes_of = [plain[kind](p) for p, _, kind in pieces]
        self.is_byte = [kind == BYTE for _, _, kind in pieces]
        self.opens_with_space = [kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces]
        self.together: dict[int, bool] = {}
        self.parts = self.cuts()

    @classmethod
    def load(cls, path: str) -> MergeCodec:
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        trainer = dict(fields(b"".join(v for n, v in model if n == 2)))
        normalizer = dict(fields(b"".join(v for n, v in model if n == 3)))
        pieces = []
        for number, value in model:
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        if trainer.get(3) != 2:
            raise ValueError("not a model of the merge type")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model normalises texts in a way that is not supported")
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has user-defined or unused pieces")
        return cls(pieces)

    def cuts(self) -> regex.Pattern:
        """A pattern of parts that no piece reaches across: before a space that follows no space, and around ASCII characters of no longer piece."""
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return regex.compile(r"(?s).+")
        used = {c for p in long for c in p}
        alone = "".join(regex.escape(chr(c)) for c in range(128) if chr(c) not in used)
        return regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """Joins the leftmost neighbours of highest score until none are left; for short texts."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text_of(self, code: int) -> str:
        return self.texts[code] if code < len(self.texts) else chr(code - len(self.texts))

    def fits(self, before: int, code: int) -> bool:
        """Whether the two, merged anew, are themselves again; what is found is remembered."""
        if len(self.together) >= CACHE_ENTRIES:
            self.together.clear()
        parts = [self.text_of(c) for c in (before, code) if c != NONE]
        fits = self.merge("".join(parts)) == parts
        self.together[before << 21 | code] = fits
        return fits

    def codes(self, text: str) -> list[int]:
        n, total = len(text), len(self.texts)
        sizes, shorter, known, single = self.sizes, self.shorter, self.together.get, self.ids.get
        longest = [NONE] * n  # the longest piece that begins at each place: matches come by their ends, so the last one is it
        if len(self.automaton):
            for last, code in self.automaton.iter(text):
                longest[last + 1 - sizes[code]] = code
        for at in range(n):
            if longest[at] == NONE:
                longest[at] = single(text[at], total + ord(text[at]))
        failed = bytearray((n >> 3) + 1)
        found: list[int] = []
        at, before = 0, NONE
        code = longest[0] if n else NONE
        while at < n:
            while code != NONE:
                stop = at + (sizes[code] if code < total else 1)
                if not failed[stop >> 3] >> (stop & 7) & 1:
                    fits = known(before << 21 | code)
                    if self.fits(before, code) if fits is None else fits:
                        break
                code = shorter[code] if code < total else NONE
            if code != NONE:
                found.append(code)
                at, before = stop, code
                code = longest[at] if at < n else NONE
            else:
                failed[at >> 3] |= 1 << (at & 7)
                code = found.pop()
                at -= sizes[code] if code < total else 1
                before = found[-1] if found else NONE
                code = shorter[code] if code < total else NONE
        return found

    def pieces_of(self, text: str) -> list[str]:
        return [self.text_of(code) for code in self.codes(text)]

    def encode_part(self, part: str) -> list[int]:
        codes, total = self.codes(part), len(self.texts)
        if not codes or max(codes) < total:
            return codes
        out = []
        for code in codes:
            if code < total:
                out.append(code)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(code - total).encode())
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side, the first one without its first space; bytes that are no UTF-8 give U+FFFD each."""
        if not ids:
            return ""
        parts = [self.bytes_of[k] for k in ids]
        for at, k in enumerate(ids):  # the space that encoding put first
            if parts[at]:
                if self.opens_with_space[k]:
                    parts[at] = parts[at][1:]
                break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            out, run = [], b""
            for k, part in [*zip(ids, parts, strict=True), (None, b"")]:
                if k is not None and self.is_byte[k]:
                    run += part
                    continue
                out += [*self._run(run), part.decode()]
                run = b""
            return "".join(out)

    @staticmethod
    def _run(run: bytes) -> Iterator[str]:
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    yield run[at : at + size].decode()
                except UnicodeDecodeError:
                    continue
                break
            else:
                size = 1
                yield "�"
            at += size


class Parts(dict):
    """Encodes a part when it is first asked for. When a generation is full, it becomes the old one, and what is used of that one moves on."""

    def __init__(self, codec: MergeCodec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = np.array(self.codec.encode_part(part), "<i4").tobytes()
        if len(part) <= CACHED_PART:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


_codecs: dict[str, tuple[MergeCodec, Parts]] = {}


def _codec(path: str) -> tuple[MergeCodec, Parts]:
    """The codec and the cache of encoded parts of this Python worker."""
    if path not in _codecs:
        codec = MergeCodec.load(path)
        _codecs[path] = (codec, Parts(codec))
    return _codecs[path]


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Appends piece_ids (array<int>, without begin and end) and decoded (the text that the ids give back)."""

    def make():
        codec, parts = _codec(model_path)
        cut, lookup = codec.parts.findall, parts.__getitem__

        def step(texts: pa.Array) -> list[pa.Array]:
            data, decoded, ends = [], [], [0]
            for value in texts.to_pylist():
                ids = b"".join(map(lookup, cut(SPACE + value.replace(" ", SPACE)))) if value else b""
                data.append(ids)
                ends.append(ends[-1] + len(ids) // 4)
                decoded.append(codec.decode(np.frombuffer(ids, "<i4").tolist()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))
            return [lists, pa.array(decoded, pa.string())]

        return step

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return with_columns_from_batches(df, [text], make, fields)


def default_model() -> str:
    """Path of the public model that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame) -> DataFrame:
    decimal = F.replace(F.btrim(F.col("piece_ids").cast("string"), F.lit("[]")), F.lit(", "), F.lit(","))
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model()))
