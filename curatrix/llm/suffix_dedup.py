"""Removal of byte strings that repeat, by external induced sorting of suffixes, over shards that Spark deals out.

Every window of `window` bytes has an anchor: of its substrings of ANCHOR bytes, the one with the least hash. Windows that
are equal have equal anchors, so shards by anchor see all copies of a window. Neighbouring windows with one anchor form a
span. The stages:

1. spans of all documents: anchor, 128-bit digest of the span, document, position;
2. by anchor, as sorted streams: a span that occurs twice repeats in all its windows; anchors with one span are done;
3. anchors with several unlike spans, some of which occur once, are sorted: their spans go to shards of a bounded size,
   and induced sorting with common-prefix values finds the windows that occur twice;
4. an anchor with more than HOT unlike spans is not sorted as it is: its windows are dealt anew by the part that
   neighbouring windows share (GRIDS windows at a time, at last each by itself), through stages 2 and 3 again. So a passage
   that very many documents hold never meets in one task;
5. each document's covered bytes are cut out.

A batch links what it holds of a span before the shuffle. Anchor hashes only deal out; digests of 128 bits and the sorted
bytes decide. Windows of two sizes cost little more than those of the smaller one: a larger window repeats only where all
smaller ones in it do, so just those pieces are looked at again.

Results: null counts as empty; texts shorter than the window keep all; very long texts are read in chunks, but judged whole;
equal rows (id and text) are documents of their own, so they remove each other. Null ids are allowed; an empty table gives
no rows. Columns that have the name of a new one are replaced, others of any name are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import by_bytes, masked, staged, table, trimmed
from curatrix.llm.induced_sort import repeated_windows

#: Bytes of an anchor by bytes of a window; more make fewer chance meetings and more spans.
ANCHOR, LONG_ANCHOR, LONG_WINDOW = 64, 128, 320
#: Passages of over 50 words have so many bytes at least (words of some four bytes and a blank).
PASSAGE_BYTES = 250
#: Unlike spans of an anchor from which on its windows are dealt anew, and how many windows go together then.
HOT, GRIDS = 64, (17, 1)
#: Bytes that a shard sorts at once.
SHARD_BYTES = 1 << 20
_CHUNK = (1 << 18) - 4096
_U = np.uint64
#: Multipliers of a 64-bit finalizer, and an odd base (fixed values).
_M1, _M2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}

_ROWS = "key long, s1 long, s2 long, did long, th long, pos long, n int, anchor int, role byte"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.int8()]
# roles: a span that awaits its fellows; one whose copies are known already; all windows repeat; to be sorted; the same, without a copy
WAITS, COPIED, REPEATS, SORTS, ALONE = range(5)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def substring_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each substring of so many bytes: polynomials modulo 2**64, by prefix sums."""
    n = len(data)
    if not _powers or len(_powers["up"]) < n:
        length = max(n, 1 << 16)
        _powers["up"] = np.cumprod(np.r_[_U(1), np.full(length, _BASE, _U)])
        _powers["down"] = np.cumprod(np.r_[_U(1), np.full(length, pow(_BASE, -1, 1 << 64), _U)])
    sums = np.zeros(n + 1, _U)
    np.cumsum(_VALUES[data] * _powers["down"][:n], out=sums[1:])
    return _mixed((sums[size:] - sums[: n + 1 - size]) * _powers["up"][: n + 1 - size])


def anchor_size(window: int) -> int:
    return min(window, LONG_ANCHOR if window >= LONG_WINDOW else ANCHOR)


def spans_of(texts: list[bytes], window: int, size: int) -> list[np.ndarray]:
    """Of each span of the texts: its text, anchor's hash, digest (two columns), first window, number of windows, anchor's place after the first window.

    Texts are cut into chunks that overlap by a window, and several chunks are worked through together.
    """
    out: list[list[np.ndarray]] = []
    chunks, held = [], 0  # of texts: number, base, bytes

    def told() -> None:
        nonlocal chunks, held
        if chunks:
            out.append(_chunk_spans(chunks, window, size))
        chunks, held = [], 0

    for number, data in enumerate(texts):
        for base in range(0, len(data) - window + 1, _CHUNK):
            part = data[base : base + _CHUNK + window - 1]
            if held + len(part) > _CHUNK + window - 1:
                told()
            chunks.append((number, base, part))
            held += len(part)
    told()
    if not out:
        return [np.empty(0, np.int64) for _ in range(7)]
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _chunk_spans(chunks: list[tuple[int, int, bytes]], window: int, size: int) -> list[np.ndarray]:
    whole = b"".join([c[2] for c in chunks])
    hashes = substring_hashes(np.frombuffer(whole, np.uint8), size)
    width, n = window - size + 1, len(whole) - window + 1
    order = (hashes & ~_U(0xFFFFF)) | np.arange(len(hashes), dtype=_U)  # ties go to the first
    padded = np.full(-(-len(order) // width) * width, ~_U(0), _U)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    onwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(onwards[:n], upto[width - 1 : width - 1 + n]) & _U(0xFFFFF)).astype(np.int64)
    opens, inside = np.r_[True, place[1:] != place[:-1]], np.zeros(n, bool)
    at = np.cumsum([0, *[len(c[2]) for c in chunks]])
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # windows that stay in their chunk
        inside[begin : end - window + 1] = True
        opens[begin] = True
    start = np.flatnonzero(opens & inside)
    stops = np.r_[np.flatnonzero(opens | ~inside), n]
    count = stops[np.searchsorted(stops, start, side="right")] - start
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(whole[a:b]) for a, b in zip(start.tolist(), (start + count - 1 + window).tolist(), strict=True)])
    s1, s2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T
    chunk = np.searchsorted(at, start, side="right") - 1
    number, base = (np.array([c[k] for c in chunks], np.int64)[chunk] for k in (0, 1))
    return [number, hashes[place[start]].view(np.int64), s1, s2, base + start - at[chunk], count, place[start] - start]


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _linked(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of a batch's spans: equal ones repeat at once, and one of them goes on."""
    key, s1, s2 = columns[:3]
    order = np.lexsort((s2, s1, key))
    columns = [c[order] for c in columns]
    key, s1, s2 = columns[:3]
    like = (key[1:] == key[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
    again, first = np.r_[False, like], np.r_[like, False]
    columns[8] = np.where(first & ~again, COPIED, columns[8]).astype(np.int8)
    repeats = again | first
    if repeats.any():
        yield _batch(_runs([c[repeats] for c in columns]))
    yield _batch([c[~again] for c in columns])


def _runs(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Spans that repeat, as REPEATS rows; those that follow each other in a document become one."""
    order = np.lexsort((columns[5], columns[4], columns[3]))
    columns = [c[order] for c in columns]
    did, th, pos, n = columns[3], columns[4], columns[5], columns[6]
    start = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + n[:-1])])
    out = [c[start] for c in columns]
    out[6] = np.add.reduceat(n, start).astype(np.int32)
    out[8] = np.full(len(start), REPEATS, np.int8)
    return out


def spans(docs: DataFrame, window: int) -> DataFrame:
    """Stage 1, of documents (did, th, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 8 << 20):
                did, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                number, key, s1, s2, pos, n, anchor = spans_of([x or b"" for x in batch.column(2).to_pylist()], window, anchor_size(window))
                if len(number):
                    columns = [key, s1, s2, did[number], th[number], pos, n, anchor, np.full(len(number), WAITS)]
                    yield from _linked([c.astype(k.to_pandas_dtype()) for c, k in zip(columns, _KINDS, strict=True)])

    return docs.select("did", "th", "data").mapInArrow(trimmed(run), _ROWS)


def compared(rows: DataFrame) -> DataFrame:
    """Stage 2: REPEATS rows, and SORTS and ALONE rows, one for each of several unlike spans of an anchor.

    Rows come sorted by anchor and span; a row waits for the next one, and an anchor's first span for a second one. What is
    known to repeat only passes, dealt by document.
    """
    deal = F.when(F.col("role") == REPEATS, F.xxhash64("did", "th", "pos")).otherwise(F.col("key"))
    ordered = rows.repartition(deal).sortWithinPartitions("key", F.col("role") == REPEATS, "s1", "s2", F.desc("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None  # rows not told yet; the first span of the open anchor while it has no second one
        before = (None, None, None)

        def told(columns: list[np.ndarray], after: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal first, before
            key, s1, s2, role = columns[0], columns[1], columns[2], columns[8]
            n = len(key)
            same_key = np.r_[before[0] is not None and key[0] == before[0], key[1:] == key[:-1]]
            same_span = same_key & np.r_[(s1[0], s2[0]) == before[1:], (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]
            next_span = np.r_[same_span[1:], after == (key[-1], s1[-1], s2[-1])]
            repeats = (same_span | next_span) & (role != COPIED)
            if repeats.any():
                done = [c[repeats] for c in columns]
                done[8] = np.full(int(repeats.sum()), REPEATS, np.int8)
                yield _batch(done)
            opens = ~same_span  # the first row of its span
            kind = np.where(next_span | (role == COPIED), SORTS, ALONE).astype(np.int8)
            columns = [*columns[:8], kind]
            second = opens & same_key  # its anchor has another span before
            starts = np.flatnonzero(~same_key)
            run_of = np.cumsum(~same_key) - 1  # -1: the anchor that was open already
            has_second = np.zeros(len(starts) + 1, bool)
            has_second[run_of[second] + 1] = True
            if first is not None and has_second[0]:
                yield _batch([np.array([x]) for x in first])
                first = None
            take = second.copy()
            take[starts[has_second[1:]]] = True
            if len(starts):
                k = starts[-1]
                first = None if has_second[-1] else [c[k] for c in columns]
            before = (key[-1], s1[-1], s2[-1])
            if take.any():
                yield _batch([c[take] for c in columns])

        for batch in batches:
            columns = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            passes = columns[8] == REPEATS
            if passes.any():
                yield _batch([c[passes] for c in columns])
                columns = [c[~passes] for c in columns]
            if held is not None:
                columns = [np.r_[h, c] for h, c in zip(held, columns, strict=True)]
            if len(columns[0]) > 1:
                yield from told([c[:-1] for c in columns], (columns[0][-1], columns[1][-1], columns[2][-1]))
                columns = [c[-1:] for c in columns]
            held = columns if len(columns[0]) else None
        if held is not None:
            yield from told(held, (None, None, None))

    return ordered.mapInArrow(trimmed(run), _ROWS)


def with_bytes(rows: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """rows with the bytes of their spans: the texts that hold them are read once more."""
    cells = ["key", "pos", "n", "anchor", "role"]
    listed = rows.groupBy(F.col("did").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct(*cells)).alias("cells"))
    found = docs.join(listed, (docs.did == listed.d) & (docs.th == listed.t)).select("did", "th", "data", "cells")
    schema = "key long, did long, th long, pos long, n int, anchor int, role byte, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 4 << 20):
                rows = []
                for did, th, value, listed in zip(*batch.columns, strict=True):
                    data, did, th = value.as_py(), did.as_py(), th.as_py()
                    rows += [(c["key"], did, th, c["pos"], c["n"], c["anchor"], c["role"], data[c["pos"] : c["pos"] + c["n"] - 1 + window]) for c in listed.as_py()]
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int8(), pa.binary()]
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "did", "th", "pos", "n", "anchor", "role", "data"])

    return found.mapInArrow(trimmed(run), schema)


def dealt_anew(rows: DataFrame, window: int, grid: int) -> DataFrame:
    """Spans of rows (with bytes) cut into runs of `grid` windows at most, by the bytes that all windows of a run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 4 << 20):
                out = []
                for row in batch.to_pylist():
                    data, anchor, role = row["data"], row["anchor"], COPIED if row["role"] == SORTS else WAITS
                    for number in range((anchor - row["n"] + 1) // grid, anchor // grid + 1):
                        # windows that begin number * grid to number * grid + grid - 1 bytes before the anchor
                        first, last = max(0, anchor - number * grid - grid + 1), min(row["n"] - 1, anchor - number * grid)
                        core = data[anchor - number * grid : anchor - number * grid - grid + 1 + window]
                        key = _digest(core + number.to_bytes(4, "little"))[0]
                        out.append((key, *_digest(data[first : last + window]), row["did"], row["th"], row["pos"] + first, last - first + 1, anchor - first, role))
                if out:
                    yield from _linked([np.array(c, k.to_pandas_dtype()) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)])

    return rows.mapInArrow(trimmed(run), _ROWS)


def sorted_shards(rows: DataFrame, shards: int, window: int) -> DataFrame:
    """(did, th, pos, n): the runs of windows that repeat, of spans without a copy; a shard's spans are sorted together."""

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("did", "th", "pos", "role", "data")]
        out = []
        for twice, did, th, pos, role in zip(repeated_windows(columns[4], window), *columns[:4], strict=True):
            if role == ALONE and twice.any():
                edges = np.flatnonzero(np.diff(np.r_[False, twice, False].astype(np.int8)))
                out += [(did, th, pos + int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        cells = zip(*out, strict=True) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.int64()] * 3 + [pa.int32()], strict=True)], names=["did", "th", "pos", "n"])

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return rows.select(shard, "did", "th", "pos", "role", "data").groupBy("shard").applyInArrow(run, "did long, th long, pos long, n int")


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(did, th, pos, n): runs of n windows from pos on that occur twice or more, of documents (did, th, data)."""
    found, rows = [], spans(docs, window)
    for level in range(len(GRIDS) + 1):
        told = staged(compared(rows), "span-told")
        found.append(told.where(F.col("role") == REPEATS).select("did", "th", "pos", "n"))
        open_ = told.where(F.col("role").isin(SORTS, ALONE))
        keys = staged(open_.groupBy("key").agg(F.count("*").alias("unlike"), F.max("role").alias("most"), F.sum(F.col("n") + window).alias("size")).where(F.col("most") == ALONE), "span-keys")
        if keys.isEmpty():
            break
        bytes_, hot = keys.agg(F.sum(F.when(F.col("unlike") <= HOT, F.col("size"))), F.max("unlike")).first()
        data = with_bytes(open_.join(keys.select("key", "unlike"), "key"), docs, window) if hot <= HOT or level == len(GRIDS) else None
        if data is None:
            marked = open_.join(keys.select("key", (F.col("unlike") > HOT).alias("hot")), "key")
            # the role tells hot anchors from others on the way through the texts
            both = staged(with_bytes(marked.withColumn("role", F.when(F.col("hot"), -F.col("role")).otherwise(F.col("role")).cast("byte")), docs, window), "span-bytes")
            data = both.where("role > 0")
            rows = dealt_anew(both.where("role < 0").withColumn("role", (-F.col("role")).cast("byte")), window, GRIDS[level])
        if bytes_:
            found.append(staged(sorted_shards(data, int(bytes_ // SHARD_BYTES) + 1, window), "span-sorted"))
        if hot <= HOT:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def runs_of(repeated: DataFrame) -> DataFrame:
    """(did, th, runs): the runs (pos, n) of each document; equal rows share theirs."""
    return repeated.groupBy("did", "th").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))


def longer_repeats(docs: DataFrame, runs: DataFrame, window: int, longer: int) -> DataFrame:
    """repeats() of a longer window, from the runs of a shorter one: only in pieces that runs cover can longer windows repeat."""
    listed = runs.select(F.col("did").alias("d"), F.col("th").alias("t"), "runs")
    found = docs.join(listed, (docs.did == listed.d) & (docs.th == listed.t)).select("did", "th", "data", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 4 << 20):
                rows = []
                for did, th, data, listed in zip(*batch.columns, strict=True):
                    did, th, data = did.as_py(), th.as_py(), data.as_py()
                    rows += [(did, th, pos, data[pos:end]) for pos, end in joined(listed, window) if end - pos >= longer]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["did", "th", "base", "data"])

    pieces = found.mapInArrow(trimmed(run), "did long, th long, base long, data binary").withColumn("piece", F.xxhash64("th", "base"))
    pieces = staged(pieces, "span-pieces")
    inner = repeats(pieces.select("did", F.col("piece").alias("th"), "data"), longer).select(F.col("did").alias("d"), F.col("th").alias("t"), "pos", "n")
    bases = pieces.select("did", "th", "piece", "base").distinct()
    return inner.join(bases, (F.col("did") == F.col("d")) & (F.col("piece") == F.col("t"))).select("did", "th", (F.col("base") + F.col("pos")).alias("pos"), "n")


def joined(listed: pa.Scalar, window: int) -> list[tuple[int, int]]:
    """The byte ranges of runs of windows that follow each other without a gap between windows."""
    out: list[tuple[int, int]] = []
    for pos, n in sorted((r["pos"], r["n"]) for r in listed.as_py() or ()):
        if out and pos <= out[-1][1] - window + 1:
            out[-1] = (out[-1][0], max(out[-1][1], pos + n - 1 + window))
        else:
            out.append((pos, pos + n - 1 + window))
    return out


def without_repeats(docs: DataFrame, window: int = 400, shorter: int | None = None, as_text: bool = False) -> DataFrame:
    """docs (doc_id, text, others) with n_bytes, n_removed, n_spans and kept: the text's bytes but those that repeated windows cover.

    With `shorter`, n_repeated as well: how many bytes repeated windows of that size cover. With `as_text`, kept_text: null
    texts stay null, and a character that loses some of its bytes goes.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept", *(["n_repeated"] if shorter else []), *(["kept_text"] if as_text else [])]
    if shorter and shorter > window:
        raise ValueError("shorter must not exceed the window")
    docs, back = masked(docs, ["doc_id", "text"])
    names = docs.columns
    did, th = F.coalesce("doc_id", F.lit(-1)), F.xxhash64("doc_id", "text")
    rows = docs.select(did.alias("did"), th.alias("th"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    runs = runs_of(repeats(rows, shorter or window))
    if shorter:
        small = staged(runs, "span-runs")
        lists = small.select("did", "th", F.col("runs").alias("__small")).join(runs_of(longer_repeats(rows, small, shorter, window)), ["did", "th"], "left")
    else:
        lists = runs.withColumn("__small", F.lit(None).cast(runs.schema["runs"].dataType))
    lists = lists.select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("runs").alias("__runs"), "__small")
    marked = docs.withColumn("__a", did).withColumn("__b", th)
    joins = marked.join(lists, (F.col("__a") == F.col("__did")) & (F.col("__b") == F.col("__th")), "left")
    cells = joins.select(*names, F.col("text").cast("binary").alias("__data"), "__runs", "__small")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary" + (", n_repeated long" if shorter else "") + (", kept_text string" if as_text else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                sizes, removed, pieces, kept, repeated, texts = [], [], [], [], [], []
                for value, listed, small in zip(*batch.columns[len(names) :], strict=True):
                    data = value.as_py() or b""
                    cut = 0
                    parts, at, count = [], 0, 0
                    for pos, end in merged([(r["pos"], r["pos"] + r["n"] - 1 + window) for r in listed.as_py() or ()]):
                        parts.append(data[at:pos])
                        cut, at, count = cut + end - pos, end, count + 1
                    sizes.append(len(data))
                    removed.append(cut)
                    pieces.append(count)
                    kept.append(b"".join([*parts, data[at:]]) if cut else data)
                    if as_text:
                        texts.append(kept[-1].decode("utf-8", "ignore") if value.is_valid else None)
                    repeated.append(sum(end - pos for pos, end in merged([(r["pos"], r["pos"] + r["n"] - 1 + shorter) for r in small.as_py() or ()])) if shorter else 0)
                columns = [*[pa.array(x, pa.int64()) for x in (sizes, removed, pieces)], pa.array(kept, pa.binary()), *([pa.array(repeated, pa.int64())] if shorter else []), *([pa.array(texts, pa.string())] if as_text else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, *new])

    return back(cells.mapInArrow(trimmed(run), schema), new)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed are repeats of 400 bytes; n_repeated counts the bytes of repeats of PASSAGE_BYTES, so that shorter passages of over 50 words are seen."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, shorter=PASSAGE_BYTES)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
