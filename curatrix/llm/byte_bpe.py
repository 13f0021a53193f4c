"""Byte-level BPE encoding and decoding by a tree of joins.

Encoded pieces form a monoid: encode(x + y) = join(encode(x), encode(y)). A piece is cut in half until it is short; going
up, two neighbours are joined by encoding a window around the boundary anew. The window grows until the tokens on both
its edges fit what lies outside: for a rank-ordered vocabulary a token sequence is the encoding of its bytes exactly if
each pair of neighbours is the encoding of its own bytes, so nothing outside such a window can change. Decoding concatenates
the bytes of leaves of ids, and neighbours up the tree.

Results: a null text counts as empty; an empty text has no ids. Bytes of a text are its UTF-8 bytes. Very long texts, and
very long matches of the pattern, are encoded whole. An empty table gives no rows, repeated rows each get theirs; columns
that have the name of a new one (token_ids, decoded) are replaced, others of any name are kept.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import table, with_columns_from_batches

#: Pieces up to this many bytes are encoded without a tree.
LEAF_BYTES = 16
#: Ids that are decoded without a tree.
LEAF_IDS = 1 << 16
#: Strings up to this many bytes are merged by looking through all pairs, longer ones by a heap of pairs.
SHORT_BYTES = 64
#: Entries of each of the two generations of a Python worker's piece cache, and of its cache of pairs, which starts anew when full.
CACHE_ENTRIES = 120_000
#: Stands for the rank of a pair that makes no token.
_NONE = (1 << 31) - 1
#: Leaves that are merged side by side, and bytes of the texts whose new pieces are.
LEAVES, TOGETHER_BYTES = 8192, 1 << 20


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.fits_cache: dict[tuple[int, int], bool] = {}
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str) -> TreeCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """Merges the leftmost pair of least rank until none is left."""
        if len(data) > SHORT_BYTES:
            return self.merge_long(data)
        rank, none = self.ranks.get, _NONE
        parts = [data[k : k + 1] for k in range(len(data))]
        scores = [rank(data[k : k + 2], none) for k in range(len(parts) - 1)]
        while scores and (best := min(scores)) != none:
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """merge() with a heap of pairs: about linear in the length."""
        rank, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here; end 0: merged into the one before
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts is another by now
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
                if (after := end[stop]) - at <= self.longest and (r := rank(data[at:after])) is not None:
                    heapq.heappush(heap, (r, at, after))
            if (start := before[at]) >= 0 and stop - start <= self.longest and (r := rank(data[start:stop])) is not None:
                heapq.heappush(heap, (r, start, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay two tokens when they are neighbours."""
        known = self.fits_cache.get((left, right))
        if known is None:
            if len(self.fits_cache) > CACHE_ENTRIES:
                self.fits_cache.clear()
            known = self.fits_cache[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 1
        token = self.bytes_of
        while True:
            middle = self.merge(b"".join([token[t] for t in left[-i:]] + [token[t] for t in right[:j]]))
            fits_left = i == len(left) or self.fits(left[-i - 1], middle[0])
            fits_right = j == len(right) or self.fits(middle[-1], right[j])
            if fits_left and fits_right:
                return left[: len(left) - i] + middle + right[j:]
            if not fits_left:
                i = min(len(left), 2 * i)
            if not fits_right:
                j = min(len(right), 2 * j)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs of tokens make, _NONE where they make none or an end is -1."""
        if self.pairs is None:
            made = {(a << 32) | b: rank for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None}
            keys = np.array(sorted(made), np.int64)
            self.pairs = np.append(keys, np.int64(-1)), np.array([*[made[k] for k in keys.tolist()], _NONE], np.int32)
        keys, ranks = self.pairs
        wanted = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(keys[:-1], wanted)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), ranks[at], _NONE)

    def merge_many(self, leaves: list[bytes]) -> list[bytes]:
        """merge() of strings of LEAF_BYTES at most, side by side; ids as little-endian 32-bit integers."""
        single = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int32)
        if (single < 0).any():  # merge() tells whether the bytes that are no tokens occur
            return [np.array(self.merge(x), "<u4").tobytes() for x in leaves]
        out: list[bytes] = [b""] * len(leaves)
        for first in range(0, len(leaves), LEAVES):
            part = leaves[first : first + LEAVES]
            size = np.array([len(x) for x in part])
            data = np.frombuffer(b"".join([x.ljust(LEAF_BYTES, b"\0") for x in part]), np.uint8).reshape(-1, LEAF_BYTES)
            place, row = np.arange(LEAF_BYTES + 1), np.arange(first, first + len(part))
            # a token's row ends with places of -1
            ids = np.full((len(part), LEAF_BYTES + 1), -1, np.int32)
            ids[:, :-1] = np.where(place[:-1] < size[:, None], single[data], -1)
            scores = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            while len(row):
                at = scores.argmin(axis=1)
                best = scores[np.arange(len(row)), at]
                over = best == _NONE
                if over.any():
                    for k, tokens, n in zip(row[over].tolist(), ids[over].astype("<u4"), (ids[over] >= 0).sum(axis=1).tolist(), strict=True):
                        out[k] = tokens[:n].tobytes()
                    row, ids, scores, at, best = row[~over], ids[~over], scores[~over], at[~over], best[~over]
                    if not len(row):
                        break
                k = np.arange(len(row))
                ids[:, 1:-1] = np.where(place[1:-1] > at[:, None], ids[:, 2:], ids[:, 1:-1])
                ids[k, at] = best
                scores[:, :-1] = np.where(place[: LEAF_BYTES - 1] > at[:, None], scores[:, 1:], scores[:, :-1])
                scores[:, -1] = _NONE
                before = np.maximum(at - 1, 0)
                scores[k, before] = self.pair_ranks(ids[k, before], ids[k, before + 1])
                scores[k, at] = self.pair_ranks(best, ids[k, at + 1])
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_tree(data)

    def encode_tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = LEAF_BYTES << (((len(data) - 1) // LEAF_BYTES).bit_length() - 1)  # in runs of one character, the halves' tokens stay
        return self.join(self.encode_tree(data[:half]), self.encode_tree(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        token = self.bytes_of
        level = [b"".join([token[t] for t in ids[k : k + LEAF_IDS]]) for k in range(0, len(ids), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


class PieceCache:
    """Ids of pieces, as bytes, in two generations: when the new one is full it becomes the old one. Pieces in use move on to the new one."""

    def __init__(self, codec: TreeCodec):
        self.codec = codec
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, of its pieces. Short pieces that are new are merged side by side, others come up the tree."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        coded = [list(map(self.new.get, pieces)) for pieces in texts]
        made: dict[str, bytes] = {}
        leaves: list[tuple[str, bytes]] = []
        for pieces, ids in zip(texts, coded, strict=True):
            if None in ids:
                for piece in [p for p, c in zip(pieces, ids, strict=True) if c is None]:
                    if piece in made:
                        continue
                    known = self.old.get(piece)
                    if known is None:
                        data = piece.encode()
                        if len(data) <= LEAF_BYTES and data not in self.codec.ranks:
                            leaves.append((piece, data))
                            known = b""
                        else:
                            found = self.codec.encode_piece(data)
                            known = struct.pack(f"<{len(found)}I", *found)
                    made[piece] = known
        made.update(zip([p for p, _ in leaves], self.codec.merge_many([d for _, d in leaves]), strict=True))
        out = [b"".join([made[p] if c is None else c for p, c in zip(pieces, ids, strict=True)] if None in ids else ids) for pieces, ids in zip(texts, coded, strict=True)]
        for piece, ids in made.items():
            if len(self.new) >= 2 * CACHE_ENTRIES:
                break
            if len(piece) <= 64:
                self.new[piece] = ids
        return out


_codecs: dict[str, tuple[TreeCodec, PieceCache]] = {}


def _codec(path: str) -> tuple[TreeCodec, PieceCache]:
    """The codec and the piece cache of this Python worker."""
    if path not in _codecs:
        codec = TreeCodec.load(path)
        _codecs[path] = (codec, PieceCache(codec))
    return _codecs[path]


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Appends token_ids (little-endian unsigned 32-bit ids, binary) and decoded (the bytes that the ids give back, binary).

    Each match of `pattern` is encoded by itself. Null texts count as empty; columns of these two names are replaced.
    """

    def make():
        codec, cache = _codec(ranks_path)
        pieces = regex.compile(pattern).findall

        def step(texts: pa.Array) -> list[pa.Array]:
            ids: list[bytes] = []
            found: list[list[str]] = []
            held = 0
            for value in texts:
                text = value.as_py() or ""
                found.append(pieces(text))
                held += len(text)
                if held >= TOGETHER_BYTES:
                    ids += cache.encode(found)
                    found, held = [], 0
            ids += cache.encode(found)
            decoded = [codec.decode(np.frombuffer(data, "<u4").tolist()) for data in ids]
            return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

        return step

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return with_columns_from_batches(df, [text], make, fields)


def default_ranks() -> tuple[str, str]:
    """Path and split pattern of the public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_ranks()
    return digests(encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern))
