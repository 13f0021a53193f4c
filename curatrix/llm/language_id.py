"""Language identification by unigram pieces, summed over all segmentations.

For each language the pieces of a fixed public vocabulary have probabilities. A word's probability in a language is the
sum over all ways to cut it into pieces (forward algorithm over the word's characters); a text's is the product over its
words. The probabilities are learned by expectation maximisation: the forward and backward sums of the training words
give each piece's expected count.

The fit is made on a bounded, documented sample of training rows: SAMPLE_PER_LANGUAGE distinct texts with a letter for each
language (fewer if there are more than MOST_TEXTS in all, one at least), the first by a hash of the text. Texts of up to
SAMPLE_CHARS characters come first; where a language has too few, longer ones give as many characters of their beginning.
Every language that has such a text is learned, and every document is scored whole.

Results: lang_pred is a learned language; `und` with score 0 if the text is null, empty or has no letter, or if no
language was learned. Ties go to the first language in order of names. score is the posterior of the predicted language
under equal priors, on the mean evidence of EVIDENCE_WORDS words at most, so that long texts keep graded scores.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import bounded_broadcast, staged, table, with_columns_from_batches

#: Bounds of the fit: distinct training texts for each language, characters of a training text, texts in all.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, MOST_TEXTS = 300, 4000, 300 * 64
#: Parts that a language's texts are drawn from side by side.
PARTS = 16
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Words that count fully towards a score; beyond them the mean is scaled to as many.
EVIDENCE_WORDS = 50
#: Characters of the public vocabulary's longest pieces; a model goes by the longest of its own.
LONGEST_PIECE = 16
#: Words of up to so many characters have sums that doubles can hold; those of longer ones are summed as logarithms, so many characters at once.
PLAIN_CHARS, LOG_CHARS = 64, 200_000
#: Words of up to so many characters are scored side by side, and so many at once; longer ones by themselves.
SIDE_BY_SIDE, WORDS_AT_ONCE = 40, 20_000
#: Cells (words by languages) of the cache of a Python worker; when full it starts anew.
CACHE_CELLS = 400_000
#: An odd base and an odd multiplier (fixed values).
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Letters and marks make words; everything else separates them.
_WORDS = regex.compile(r"[\p{L}\p{M}]+")
_ASCII_WORDS = re.compile(r"[a-z]+")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text."""
    text = text.lower()
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


def vocabulary(path: str) -> list[str]:
    """The letter pieces of the public vocabulary, lower-cased; `_` marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).replace("▁", "_").lower() for k in range(model.get_piece_size())}
    return sorted(p for p in pieces if regex.fullmatch(r"_?[\p{L}\p{M}]+", p))


class PieceModel:
    def __init__(self, languages: list[str], pieces: list[str], weights: np.ndarray):
        """weights: probabilities, pieces by languages; the last row is that of any other character."""
        self.languages, self.pieces = languages, pieces
        self.weights = weights
        self.index = {p: k for k, p in enumerate(pieces) if p != "_"}
        self.longest = max(map(len, self.index), default=1)
        # pieces by hashes: sorted, and a table of which high bits there are
        hashes = np.array([self._hash(p) for p in self.index], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(self.index.values()), np.int64)[order] if len(order) else np.empty(0, np.int64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        self.there = np.zeros(1 << 20, bool)
        self.there[(hashes * _SPREAD) >> np.uint64(44)] = True
        self.cache: dict[str, int] = {}
        self.most = max(1000, CACHE_CELLS // max(1, len(languages)))
        self.table = np.empty((0, len(languages)))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 1
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of all arcs of `_word`s (piece -1: any other character), in order of ends; the words' places; the word of each arc.

        Places are counted through all words: word k has the places at[k] (its beginning) to at[k + 1] - 1 (its end).
        """
        codes = np.frombuffer("".join(["_" + w + "\n" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words])
        at = np.r_[0, np.cumsum(sizes)]
        word = np.repeat(np.arange(len(words)), sizes)
        begin = np.arange(len(codes))
        room = at[word + 1] - 1 - begin
        begin, room = begin[room > 0], room[room > 0]
        h = np.ones(len(begin), np.uint64)
        starts, ends, pieces = [], [], []
        single = np.zeros(len(codes), bool)
        for size in range(1, self.longest + 1):
            if size > 1:
                keep = room >= size
                begin, room, h = begin[keep], room[keep], h[keep]
            h = h * _BASE + codes[begin + size - 1]
            maybe = np.flatnonzero(self.there[(h * _SPREAD) >> np.uint64(44)])
            if len(maybe):
                k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[k] == h[maybe]
                begins, k = begin[maybe[hit]], k[hit]
                starts.append(begins)
                ends.append(begins + size)
                pieces.append(self.numbers[k])
                if size == 1:
                    single[begins] = True
        begin = np.arange(len(codes))
        alone = begin[~single & (at[word + 1] - 1 > begin)]
        start, end, piece = np.concatenate([*starts, alone]), np.concatenate([*ends, alone + 1]), np.concatenate([*pieces, np.full(len(alone), -1)])
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        return start, end, piece, at, word[start]

    @staticmethod
    def steps(far: np.ndarray) -> list[np.ndarray]:
        """Indices of arcs that are equally far, near ones first; in their order."""
        order = np.argsort(far, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(far[order])) + 1) if len(order) else []

    def forward_many(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words of up to SIDE_BY_SIDE characters, by languages: all segmentations of each are summed."""
        start, end, piece, at, word = self.arcs(words)
        sums = np.zeros((at[-1] + 1, len(self.languages)))
        sums[at[:-1]] = 1.0
        for step in self.steps(end - at[word]):
            ends = end[step]
            first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            sums[ends[first]] = np.add.reduceat(sums[start[step]] * self.weights[piece[step]], first, axis=0)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(sums[at[1:] - 1]), -700.0)

    def forward(self, word: str) -> np.ndarray:
        """forward_many() for one word of any length; sums are scaled as they go."""
        text, index, other = "_" + word, self.index.get, self.weights[-1]
        sums: list[np.ndarray] = [np.ones(len(self.languages)), other]
        scale = np.zeros(len(self.languages))
        for end in range(2, len(text) + 1):
            found = [(start, k) for start in range(max(0, end - self.longest), end) if (k := index(text[start:end])) is not None]
            total = sum((sums[start - end] * self.weights[k] for start, k in found), np.zeros(len(self.languages)))
            if not any(start == end - 1 for start, _ in found):
                total = total + sums[-1] * other
            sums = [*sums[-self.longest :], total]
            if end % 24 == 0:
                top = np.maximum(np.max(sums, axis=0), 1e-300)
                scale += np.log(top)
                sums = [s / top for s in sums]
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(sums[-1]), -700.0) + scale

    def expected(self, counts: list[Counter]) -> np.ndarray:
        """Expected piece counts of each language's words: forward and backward sums over the arcs."""
        out = np.zeros_like(self.weights)
        for language, words in enumerate(counts):
            weights, listed = self.weights[:, language], sorted(w for w in words if len(w) <= PLAIN_CHARS)
            for k in range(0, len(listed), WORDS_AT_ONCE):
                part = listed[k : k + WORDS_AT_ONCE]
                start, end, piece, at, word = self.arcs(part)
                alpha, beta = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1)
                alpha[at[:-1]] = beta[at[1:] - 1] = 1.0
                for step in self.steps(end - at[word]):
                    np.add.at(alpha, end[step], alpha[start[step]] * weights[piece[step]])
                for step in self.steps(at[word + 1] - 1 - end):
                    np.add.at(beta, start[step], beta[end[step]] * weights[piece[step]])
                whole, times = alpha[at[1:] - 1], np.array([words[w] for w in part], float)
                share = np.where(whole > 0, times / np.where(whole > 0, whole, 1), 0)
                np.add.at(out[:, language], piece, share[word] * alpha[start] * beta[end] * weights[piece])
            self.expected_long([w for w in words if len(w) > PLAIN_CHARS], words, weights, out[:, language])
        return out

    def expected_long(self, listed: list[str], times: Counter, weights: np.ndarray, out: np.ndarray) -> None:
        """Adds what words of any length have: the same sums, as logarithms."""
        with np.errstate(divide="ignore"):
            logs = np.log(weights)
        while listed:
            part, size = [], 0
            while listed and (not part or size + len(listed[-1]) <= LOG_CHARS):
                size += len(listed[-1])
                part.append(listed.pop())
            start, end, piece, at, word = self.arcs(part)
            alpha, beta = np.full(at[-1] + 1, -np.inf), np.full(at[-1] + 1, -np.inf)
            alpha[at[:-1]] = beta[at[1:] - 1] = 0.0
            for step in self.steps(end - at[word]):
                np.logaddexp.at(alpha, end[step], alpha[start[step]] + logs[piece[step]])
            for step in self.steps(at[word + 1] - 1 - end):
                np.logaddexp.at(beta, start[step], beta[end[step]] + logs[piece[step]])
            whole = alpha[at[1:] - 1]
            share = np.exp(alpha[start] + beta[end] + logs[piece] - np.where(np.isfinite(whole), whole, np.inf)[word])
            np.add.at(out, piece, share * np.array([times[w] for w in part], float)[word])

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> PieceModel:
        languages, longest = sorted(counts), max(map(len, pieces), default=1)
        used = {("_" + w)[a:b] for words in counts.values() for w in words for a in range(len(w) + 1) for b in range(a + 1, min(a + longest, len(w) + 1) + 1)}
        pieces = [p for p in pieces if p in used]
        start = np.full((len(pieces) + 1, len(languages)), 1.0)
        model = cls(languages, pieces, start / start.sum(axis=0))
        for _ in range(rounds):
            found = model.expected([counts[name] for name in languages]) + 0.05
            model = cls(languages, pieces, found / found.sum(axis=0))
        return model

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, by languages; new words join the cache."""
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set(words)
        if len(self.cache) + len(new) > len(self.table):
            table = np.empty((max(len(self.cache) + len(new), min(self.most, 2 * len(self.table))), len(self.languages)))
            table[: len(self.cache)] = self.table[: len(self.cache)]
            self.table = table
        listed = sorted(new)
        at = len(self.cache)
        self.cache.update(zip(listed, range(at, at + len(listed)), strict=True))
        for k in range(0, len(listed), WORDS_AT_ONCE):
            part = listed[k : k + WORDS_AT_ONCE]
            short = [w for w in part if len(w) <= SIDE_BY_SIDE]
            found = np.empty((len(part), len(self.languages)))
            is_short = np.array([len(w) <= SIDE_BY_SIDE for w in part])
            if short:
                found[is_short] = self.forward_many(short)
            for j in np.flatnonzero(~is_short):
                found[j] = self.forward(part[j])
            self.table[at + k : at + k + len(part)] = found
        return self.table[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def scores(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        texts = list(texts)
        total, counts, held, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), [], 0

        def add() -> None:
            nonlocal held, n
            if held:
                rows = self.rows_of([w for _, words in held for w in words])
                starts = np.cumsum([0, *[len(words) for _, words in held[:-1]]])
                np.add.at(total, [k for k, _ in held], np.add.reduceat(rows, starts, axis=0))
            held, n = [], 0

        most = min(WORDS_AT_ONCE, self.most)
        for k, text in enumerate(texts):
            words = words_of(text or "") if self.languages else []
            if words and (text.isascii() or regex.search(r"\p{L}", text)):
                counts[k] = len(words)
                for at in range(0, len(words), most):
                    part = words[at : at + most]
                    if n + len(part) > most:
                        add()
                    held.append((k, part))
                    n += len(part)
        add()
        out = []
        for found, count in zip(total, counts, strict=True):
            if not count:
                out.append(("und", 0.0))
                continue
            found = found * min(1.0, EVIDENCE_WORDS / count)
            odds = np.exp(found - found.max())
            k = int(np.argmax(found))
            out.append((self.languages[k], float(odds[k] / odds.sum())))
        return out

    def score(self, text: str | None) -> tuple[str, float]:
        return self.scores([text])[0]


def training_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Counter]:
    """Word counts of the bounded sample, by language. Its texts come to the driver."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("draw"))
    rows = rows.where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    distinct = rows.select("lang", (F.length("text") > SAMPLE_CHARS).alias("long"), "draw").distinct()
    # a frequent language is drawn from in PARTS tasks, and the one that joins them sees PARTS * SAMPLE_PER_LANGUAGE rows at most
    part = Window.partitionBy("lang", "part").orderBy("long", "draw")
    parts = distinct.withColumn("part", F.pmod("draw", F.lit(PARTS))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= SAMPLE_PER_LANGUAGE)
    first = Window.partitionBy("lang").orderBy("long", "draw")
    drawn = staged(parts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SAMPLE_PER_LANGUAGE).drop("part"), "language-draws")
    languages = drawn.where("place = 1").count()
    chosen = drawn.where(F.col("place") <= max(1, min(SAMPLE_PER_LANGUAGE, MOST_TEXTS // max(1, languages)))).select("lang", "draw")
    texts = rows.join(bounded_broadcast(chosen, 32), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    out: dict[str, Counter] = {}
    for r in texts.select("lang", "text").collect():
        out.setdefault(r["lang"], Counter()).update(words_of(r["text"]))
    return out


def identify(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """Appends lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.weights))  # at most the vocabulary
    key = uuid.uuid4().hex

    def make() -> Callable:
        if _models.get("key") != key:
            _models.update(key=key, model=PieceModel(*shared.value))
        scores = _models["model"].scores

        def step(texts: pa.Array) -> list[pa.Array]:
            found = scores(t.as_py() for t in texts)
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_columns_from_batches(docs, [text], make, fields)


_models: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0. Rows without an id are not held out, nor are they learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> PieceModel:
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    return PieceModel.fit(training_words(train), vocabulary(default_vocabulary()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
