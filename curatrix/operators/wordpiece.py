"""Fixed-length encoding of texts for a sub-word classifier: a basic tokenizer, then greedy longest pieces of a vocabulary.

Texts are brought to compatibility form, invisible characters go, white space becomes single blanks, letters lower case. Control
characters are dropped; punctuation, symbols and CJK characters are tokens of their own. A token of more than 100
characters, or one that pieces don't cover, is [UNK].
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The special tokens; the mark of pieces inside a token; the length of tokens and of rows.
PAD, UNK, CLS, SEP = SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
INSIDE = "##"
LONGEST_TOKEN, LENGTH = 100, 96
# Characters without a width, white space, controls, and ranges of CJK characters.
_INVISIBLE = regex.compile("[​-‍⁠﻿]")
_SPACE = regex.compile("[\t\n\x0b\x0c\r \xa0  -     　]+")
_CONTROL = regex.compile("[\x00-\x1f\x7f-\x9f]")
_CJK = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002ceaf\U0002f800-\U0002fa1f"
_TOKEN = regex.compile(rf"[\p{{P}}\p{{S}}{_CJK}]|[^ \p{{P}}\p{{S}}{_CJK}]+")

#: A vocabulary goes to every task: its tokens may have so many bytes together.
VOCABULARY_BYTES = 32 << 20
#: Pieces of so many tokens are remembered by a task.
CACHE_ENTRIES = 100_000


def normalized(text: str) -> str:
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _SPACE.sub(" ", _INVISIBLE.sub("", text)).strip(" ").lower()


def basic_tokens(text: str) -> Iterator[str]:
    """Tokens of a text as they come, so that a reader may stop early."""
    return (m.group() for m in _TOKEN.finditer(_CONTROL.sub("", normalized(text))))


class PrefixTree:
    """Words and the ids they stand for; (node, character) leads to the next node, whatever a word's length."""

    def __init__(self) -> None:
        self.next: dict[int, int] = {}
        self.ids = [-1]

    def add(self, word: str, own: int) -> None:
        node = 0
        for char in word:
            edge = node << 21 | ord(char)
            node = self.next.get(edge, 0)
            if not node:
                node = self.next[edge] = len(self.ids)
                self.ids.append(-1)
        self.ids[node] = own

    def longest(self, text: str, at: int) -> tuple[int, int]:
        """(id, end) of the longest word that the text has at a place; (-1, at) if there is none."""
        node, found, end = 0, -1, at
        for k in range(at, len(text)):
            node = self.next.get(node << 21 | ord(text[k]), 0)
            if not node:
                break
            if self.ids[node] >= 0:
                found, end = self.ids[node], k + 1
        return found, end


class Encoder:
    def __init__(self, ids: dict[str, int]):
        missing = [t for t in SPECIAL if t not in ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.pad, self.unk, self.cls, self.sep = (ids[t] for t in SPECIAL)
        self.first, self.inside = PrefixTree(), PrefixTree()
        for token, own in ids.items():
            if token:
                self.first.add(token, own)
            if len(token) > len(INSIDE) and token.startswith(INSIDE):
                self.inside.add(token[len(INSIDE) :], own)
        self.known: dict[str, list[int]] = {}

    def pieces(self, token: str) -> list[int]:
        if len(token) > LONGEST_TOKEN:
            return [self.unk]
        out, at, tree = [], 0, self.first
        while at < len(token):
            own, at = tree.longest(token, at)
            if own < 0:
                return [self.unk]
            out.append(own)
            tree = self.inside
        return out

    def encode(self, text: str, length: int) -> list[int]:
        """Ids from [CLS] to [SEP], `length` at most; what is beyond is cut, [SEP] stays."""
        out = [self.cls]
        for token in basic_tokens(text):
            if len(out) >= length:
                break
            own = self.known.get(token)
            if own is None:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                own = self.known[token] = self.pieces(token)
            out += own
        return [*out[: length - 1], self.sep]


def vocabulary_ids(vocabulary: DataFrame, token: str = "token", own: str = "id") -> dict[str, int]:
    """A vocabulary table of bounded size as a dictionary; of a token that is there twice the smaller id counts."""
    size = vocabulary.agg(F.sum(F.octet_length(token))).first()[0] or 0
    if size > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to go to every task")
    rows = vocabulary.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(own).alias("own"))
    return {r[token]: r["own"] for r in rows.collect()}


def encode_batch(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, ids, mask): arrays of `length` ids, padded, and of 1 where there is a token. A null text is an empty one."""
    ids = vocabulary_ids(vocabulary)
    Encoder({t: ids[t] for t in SPECIAL if t in ids})  # complains here, not in a task
    kind = rows.schema[key].dataType.simpleString()
    make: Callable[[], Encoder] = lambda: Encoder(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            cells = np.full((batch.num_rows, length), encoder.pad, np.int32)
            mask = np.zeros((batch.num_rows, length), np.int32)
            for k, value in enumerate(batch.column(1)):
                own = encoder.encode(value.as_py() or "", length)
                cells[k, : len(own)] = own
                mask[k, : len(own)] = 1
            ends = pa.array(np.arange(0, cells.size + 1, length), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (cells, mask))], names=[key, "ids", "mask"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, mask array<int>")


def vocabulary_from(texts: DataFrame, text: str, longest_suffix: int = 4) -> DataFrame:
    """(token, id): special tokens, all words of the texts, of any length, their characters, and their ends of up to longest_suffix letters as inner pieces."""
    from curatrix.plans.ranking import ranked

    word = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+"), F.lit(0))).alias("token")).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest_suffix), F.length("token"))), lambda n: F.concat(F.lit(INSIDE), F.right("token", n)))
    chars = F.split("token", "")
    pieces = word.select(F.explode(F.concat(F.array("token"), ends, chars, F.transform(chars, lambda c: F.concat(F.lit(INSIDE), c)))).alias("token"))
    pieces = pieces.where(~F.col("token").isin("", INSIDE, *SPECIAL)).distinct()
    special = texts.sparkSession.createDataFrame([(t, k) for k, t in enumerate(SPECIAL)], "token string, id long")
    return special.unionByName(ranked(pieces, "token", name="id").withColumn("id", F.col("id") + len(SPECIAL)))
