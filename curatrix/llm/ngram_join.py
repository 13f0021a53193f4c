"""Exact Jaccard self-join over word n-gram sets, by universe partition and pigeonhole.

1. Each text becomes the set of its distinct word n-grams (hashes of 64 bits); equal sets are one node.
2. Sets fall into size bands. Two sets of a band's reach that are similar differ in at most H elements. The universe is
   hashed into segments; a segment is indexed by the subset that falls into it (worth 1), or by the subset and all subsets
   with one element deleted (worth 2). If the worths add up to H + 1, two similar sets agree in a segment within what it
   is worth. How many segments are of which kind, and whether there are spare ones so that a set may leave out its tiny
   subsets, is the cheapest choice by the band's row count and mean size.
3. Sets that meet in a segment form a bucket; each member is compared with the bucket's first exact member, its center:
   counts by bins end most pairs, the exact sets decide the rest. So a large group of copies is linked by as many pairs
   as it has members.
4. Members of a bucket may be similar to each other, but not to its center c. Of two sets the symmetric difference is that
   of their deltas D(x) = x ^ c and D(y) = y ^ c, so the deltas of two similar members overlap, and their prefixes (in an
   order that ends with common elements) meet. If one of them is similar to c, the other is within the ring of twice H
   around c: there both meet by the deltas from c, which are small. If neither is, both meet by prefixes of their own sets
   (deltas from the empty set), one list for each set however many buckets it is in. The order is by how many deltas have
   an element, counted exactly, rarest first: a set of which many elements are its own meets nothing. Prefix elements deal
   the members out;
   each meeting is again compared with one member first, and only sets outside the meeting's largest component are
   compared pair by pair.

Buckets are read as sorted streams and never held. Two sets that have one name of 64 bits are noticed by 128 bits and get
other names. Intersections are counted on the 64-bit hashes of the n-grams: within one pair, two unlike n-grams of one
hash would be counted as one (for sets of a thousand, a chance of about 1e-13).

Results: null texts, empty texts and texts of white space have n = 0 and link with nothing; very long texts are read whole.
Rows without an id take part; they have the smallest id that they reach, null if none. Repeated rows each get their row;
an empty table gives none. Only doc_id and text are read, so further columns of any name do no harm. Words are split at
the ASCII white space, A-Z is lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import bounded_broadcast, by_bytes, discard, release, staged, table, trimmed
from curatrix.llm.components import components

_U = np.uint64
#: Multipliers of a 64-bit finalizer (fixed values).
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: What comparing a pair costs, in rows of the index.
PAIR_COST = 4.0
#: Which elements are common is told from a sample: so many of them, or this share if that is more. Those count that so many
#: of the sample share, the most common ones, so many in all at most. This sets an order only: results don't depend on it.
ORDER_SAMPLE, ORDER_SHARE, COMMON, MOST_COMMON = 1 << 22, 1 / 64, 256, 1 << 19
#: Deltas are first held against each other by so many times the share of elements that two similar sets may differ in.
ALONE_SHARE = 2
#: Least bins of the counts by which pairs are told apart before their sets are compared; larger sets have a bin for two elements.
BINS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; fewer than n words are one n-gram."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    out = h[: len(h) - width + 1] + _U(width)
    for k in range(1, width):
        out = out * _STEP + h[k : len(h) - width + 1 + k]
    out = np.sort(mixed(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def node_of(elements: np.ndarray, clashing: frozenset[int] = frozenset()) -> tuple[int, int]:
    """The name of a set, and as many bits again: with both, sets are told apart. Names in `clashing` are those of several sets."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    node, check = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
    if node in clashing:
        node = int.from_bytes(xxhash.xxh3_64_digest(digest, seed=len(clashing)), "little", signed=True)
    return node, check


@dataclass(frozen=True)
class Band:
    low: int  # least size of the band's own sets
    high: int  # greatest size
    most: int  # H: in how many elements two similar sets can differ, the larger of this band
    singles: int  # segments indexed by their subset
    doubles: int  # segments indexed with one-deletion neighbours as well
    tiny: int = -1  # segments of so many elements need no index row,
    spare: int = 0  # as long as a set has no more than so many of them


def band_starts(percent: int, largest: int) -> list[int]:
    """Starts of the size bands. A band is wider than the reach of the threshold, so a set meets its own and the next one."""
    ratio, starts = max(1.5, 120 / percent), [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, math.ceil(starts[-1] * ratio)))
    return starts


def allocate(low: int, high: int, percent: int, sets: int, mean_size: float) -> Band:
    """The cheapest segments of either kind whose worths add up to H + 1.

    The cost is that of index rows, and of pairs of unlike sets that meet in a segment that is (nearly) empty in both. With
    spare segments, a set may leave out as many tiny ones; the few sets that have more than that show all of theirs.
    """
    most = (100 - percent) * 2 * high // (100 + percent)
    if not most:
        return Band(low, high, 0, 0, 0)

    def at_most(tiny: int, share: float) -> float:
        return sum(math.exp(-share) * share**k / math.factorial(k) for k in range(tiny + 1))

    choices = []
    for doubles in range((most + 1) // 2 + 1):
        singles = most + 1 - 2 * doubles
        share = mean_size / (singles + doubles)
        rows = sets * (singles + doubles * (1 + share))
        pairs = sets**2 / 2 * (singles * at_most(0, share) ** 2 + doubles * at_most(1, share) ** 2)
        choices.append((rows + PAIR_COST * pairs, doubles, Band(low, high, most, singles, doubles)))
    for tiny in range(3):
        for spare in range(most + 1):
            segments = most + 1 + spare
            expected = segments * at_most(tiny, low / segments)
            if spare >= expected + 2 * math.sqrt(expected):
                empty = at_most(tiny, mean_size / segments)
                rows = sets * segments * (1 - empty)
                pairs = (sets / 40) ** 2 / 2 * segments * at_most(0, mean_size / segments) ** 2
                choices.append((rows + PAIR_COST * pairs, most + 2 + tiny, Band(low, high, most, segments, 0, tiny, spare)))
                break
    return min(choices, key=lambda c: c[:2])[2]


def signatures(elements: np.ndarray, bands: list[Band], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket names of a set, and of which kind each is: 0 the subset itself, 1 a subset with an element deleted."""
    names, kinds, size = [], [], len(elements)
    for number, band in enumerate(bands):
        own, reach = band.low <= size <= band.high, size < band.low and size * 100 >= percent * band.low
        segments = band.singles + band.doubles
        if not (own or reach) or not segments:
            continue
        salt = np.array([number + 1], np.uint64) * _STEP
        value = mixed(elements + salt)
        segment = ((value >> _U(32)) * _U(segments)) >> _U(32)
        order = np.argsort(segment, kind="stable")
        value, segment = mixed(value[order] + _STEP), segment[order].astype(np.int64)
        base = mixed(np.arange(1, segments + 1, dtype=np.uint64) * _M1 + salt)
        total = np.zeros(segments, np.uint64)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        total[segment[first]] = np.add.reduceat(value, first)
        shown = np.bincount(segment, minlength=segments) > band.tiny
        shown[: band.doubles] = True
        if (~shown).sum() > band.spare:
            shown[:] = True
        names.append(mixed(base + total)[shown])
        kinds.append(np.zeros(int(shown.sum()), np.int8))
        if band.doubles:
            within = segment < band.doubles
            names.append(mixed((base + total)[segment[within]] - value[within]))
            kinds.append(np.ones(int(within.sum()), np.int8))
    if not names:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    return np.concatenate(names), np.concatenate(kinds)


_BUCKETS = "sig long, kind byte, node long, size int"


def _record(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def binned(elements: np.ndarray) -> bytes:
    """Counts of a set's elements by bins, 255 at most. The number of bins is a power of two."""
    bins = max(BINS, 1 << (len(elements) // 2).bit_length())
    return np.minimum(np.bincount(((elements >> _U(20)) & _U(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at least, by their bins; the finer ones are added up to the coarser ones."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    bins = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, bins).sum(axis=0) - y.reshape(-1, bins).sum(axis=0)).sum())


def profiles(docs: DataFrame, n: int, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, n_shingles, node, check, tkey, bins): a row for each document; node is null for empty sets. tkey hashes the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                rows = []
                for value in batch.column(1):
                    elements = ngram_set(value.as_py(), n)
                    rows.append((len(elements), *node_of(elements, clashing), binned(elements)) if len(elements) else (0, None, None, None))
                cells = zip(*rows, strict=True) if rows else [[]] * 4
                sizes, nodes, checks, bins = (pa.array(x, k) for x, k in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, nodes, checks, batch.column(2), bins], names=["doc_id", "n_shingles", "node", "check", "tkey", "bins"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_shingles long, node long, check long, tkey long, bins binary")


def bucket_rows(docs: DataFrame, n: int, percent: int, bands: list[Band], clashing: frozenset[int] = frozenset()) -> DataFrame:
    """Index rows of each set of a batch: bucket, kind, node and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 4 << 20):
                seen, sigs, kinds, nodes, sizes = set(), [], [], [], []
                for value in batch.column(0):
                    elements = ngram_set(value.as_py(), n)
                    if not len(elements) or (node := node_of(elements, clashing)[0]) in seen:
                        continue
                    seen.add(node)
                    sig, kind = signatures(elements, bands, percent)
                    sigs.append(sig)
                    kinds.append(kind)
                    nodes.append(np.full(len(sig), node, np.int64))
                    sizes.append(np.full(len(sig), len(elements), np.int32))
                if sigs:
                    yield _record("sig kind node size", np.concatenate(sigs).view(np.int64), np.concatenate(kinds), np.concatenate(nodes), np.concatenate(sizes))

    return docs.select("text").mapInArrow(trimmed(run), _BUCKETS)


def bucket_links(index: DataFrame) -> DataFrame:
    """(center, center_size, node, size, more): every member of a bucket beside the bucket's first exact member.

    Rows of a bucket arrive sorted, exact members first; only the first one is kept in mind. more: the bucket has further
    members (or may have some in the next batch).
    """
    ordered = index.repartition("sig").sortWithinPartitions("sig", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # sig, kind, node, size of the first row of the bucket that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, kind, node, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            opens = np.r_[last is None or sig[0] != last[0], sig[1:] != sig[:-1]]
            start = np.flatnonzero(opens)
            at = np.cumsum(opens)  # 0: the bucket that was open already
            first_kind, first_node, first_size = (np.r_[0 if last is None else last[k], x[start]][at] for k, x in ((1, kind), (2, node), (3, size)))
            if len(start):
                last = tuple(x[start[-1]] for x in (sig, kind, node, size))
            member = first_node != node
            others = np.bincount(at[member & ~np.r_[False, (node[1:] == node[:-1]) & ~opens[1:]]], minlength=at[-1] + 1)
            others[0] += 2
            others[-1] += 2
            take = (first_kind == 0) & member
            if take.any():
                yield _record("center center_size node size more", first_node[take].astype(np.int64), first_size[take].astype(np.int32), node[take], size[take], others[at[take]] > 1)

    return ordered.mapInArrow(trimmed(run), "center long, center_size int, node long, size int, more boolean")


def _reachable(percent: int, a: str, b: str):
    """Whether two sizes allow for similarity."""
    return (F.least(a, b) * 100 >= percent * F.greatest(a, b)) & (F.col(a) > 0)


def is_near(percent: int, d: str, a: str, b: str):
    """Whether sets of sizes a and b with d elements in one of them only are similar."""
    return F.col(d) * (100 + percent) <= (100 - percent) * (F.col(a) + F.col(b))


def in_ring(percent: int, d: str, a: str, b: str):
    """Whether a set that is similar to both may exist."""
    return F.col(d) * (100 + percent) * percent <= (100 - percent) * (percent * (F.col(a) + F.col(b)) + 200 * F.least(a, b))


def exact_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, n: int, clashing: frozenset[int]) -> DataFrame:
    """(node, elements) of the nodes: one text of each is read once more. A node may come twice."""
    wanted = staged(classes.join(nodes.distinct(), "node").select(F.col("from.doc_id").alias("want_id"), F.col("from.tkey").alias("want_key"), "node"), "ngram-wanted")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    found = rows.join(bounded_broadcast(wanted, 24), rows.doc_id.eqNullSafe(F.col("want_id")) & (rows.tkey == F.col("want_key"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 4 << 20):
                nodes, sets = [], []
                for node, value in zip(*batch.columns, strict=True):
                    elements = ngram_set(value.as_py(), n)
                    if len(elements) and node_of(elements, clashing)[0] == node.as_py():
                        nodes.append(node.as_py())
                        sets.append(elements.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "elements"])

    return found.mapInArrow(trimmed(run), "node long, elements array<long>")


def maybe_near(pairs: DataFrame, classes: DataFrame, percent: int, ring: bool = False) -> DataFrame:
    """(u, v, nu, nv): of the pairs (u, v), those that the counts by bins leave, staged. Counts differ by as much as the sets do at most."""

    def of(k: str) -> DataFrame:
        return classes.select(F.col("node").alias(k), F.col("size").cast("long").alias(f"n{k}"), F.col("from.bins").alias(f"b{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [least_difference(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(least, pa.int64())], names=["u", "v", "nu", "nv", "least"])

    sizes = [classes.select(F.col("node").alias(k), F.col("size").cast("long").alias(f"n{k}")) for k in "uv"]
    pairs = pairs.select("u", "v").join(sizes[0], "u").join(sizes[1], "v").withColumn("least", F.abs(F.col("nu") - F.col("nv")))
    pairs = pairs.where((in_ring if ring else is_near)(percent, "least", "nu", "nv")).select("u", "v")
    both = pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "nu", "nv", "bu", "bv")
    found = both.mapInArrow(trimmed(run), "u long, v long, nu long, nv long, least long")
    return staged(found.where((in_ring if ring else is_near)(percent, "least", "nu", "nv")).drop("least"), "ngram-maybe")


def distances(left: DataFrame, sets: DataFrame, percent: int, ring: bool = False) -> DataFrame:
    """(u, v, nu, nv, d) of pairs (u, v, nu, nv) that are similar, or (ring) as near as two that are similar to a third, staged; exact, on the sets."""
    # only the sets of these pairs are dealt out
    eu, ev = (sets.join(bounded_broadcast(staged(left.select(F.col(k).alias("node")).distinct(), "ngram-ends"), 16), "node").select(F.col("node").alias(k), F.col("elements").alias(f"e{k}")) for k in "uv")
    d = F.col("nu") + F.col("nv") - 2 * F.size(F.array_intersect("eu", "ev"))
    found = left.join(ev, "v").join(eu, "u").select("u", "v", "nu", "nv", d.alias("d"))
    return staged(found.where((in_ring if ring else is_near)(percent, "d", "nu", "nv")), "ngram-near")


def keyed(around: int, elements: np.ndarray) -> np.ndarray:
    """Names of elements around a center."""
    return mixed(elements + mixed(np.array([around], np.int64).view(np.uint64)))


def common_keys(deltas: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of elements that COMMON or more of a sample of deltas share, the most common ones, and their counts; MOST_COMMON at most."""
    total = deltas.agg(F.sum(F.size("delta"))).first()[0] or 0
    share = min(1.0, max(ORDER_SHARE, ORDER_SAMPLE / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for around, delta in zip(*batch.columns, strict=True):
                yield _record("key", keyed(around.as_py(), delta.values.to_numpy().view(np.uint64)).view(np.int64))

    drawn = deltas.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(1 << 20)) < int(share * (1 << 20))).where(F.size("delta") > 0)
    counts = staged(drawn.select("around", "delta").mapInArrow(trimmed(run), "key long").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON), "ngram-common")
    least, there = COMMON, 0
    for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        there += r["count"]
        if there > MOST_COMMON:
            least = 2 << r["power"]
            break
    found = counts.where(F.col("c") >= least).toArrow()
    discard(counts)
    key, c = (found.column(k).to_numpy() for k in ("key", "c"))
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], c[order]


def crowded(deltas: DataFrame, percent: int) -> DataFrame:
    """(around, node) of the deltas (around, node, size, most, delta) that may meet another delta from their set.

    A delta with `most` elements that no other one has is similar to none. Most deltas show that by the elements of a share of
    the universe, so only these are dealt out, each with its delta's name; the deltas that don't are left to prefixes().
    """
    shared = deltas.sparkSession.sparkContext.broadcast(common_keys(deltas)[0])
    limit = min(1 << 32, (ALONE_SHARE * (100 - percent) << 32) // 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for around, node, delta in zip(*batch.columns, strict=True):
                key = keyed(around.as_py(), delta.values.to_numpy().view(np.uint64))
                key = key[key >> _U(32) < _U(limit)]
                if len(common):  # no delta is alone with these
                    key = key[common[np.minimum(np.searchsorted(common, key), len(common) - 1)] != key]
                yield _record("key around node", key.view(np.int64), np.full(len(key), around.as_py()), np.full(len(key), node.as_py()))

    met = deltas.where(F.size("delta") > 0)
    rows = met.select("around", "node", "delta").mapInArrow(trimmed(run), "key long, around long, node long").repartition("key")
    # a key has its around in it; a delta that comes twice is one delta
    own = rows.groupBy("key").agg(F.min("around").alias("around"), F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    alone = own.groupBy("around", "node").agg(F.count("*").alias("alone"))
    each = met.select("around", "node", "most").distinct()
    return each.join(alone, ["around", "node"], "left").where("alone is null or alone < most").select("around", "node")


def prefixes(deltas: DataFrame) -> DataFrame:
    """(key, place, node, size, d) of deltas (around, node, size, most, delta): the first `most` elements of each delta, but
    those that no other delta has: they meet nothing, and only their number counts, for the places of the others.

    Rare elements come first, by the number of deltas from one set that have them, counted over all deltas; those that a sample
    tells to be common come last, the most common at the end. Any order serves that is one order for all deltas from one set.
    With this one, deltas that have many elements of their own meet nothing, and others seldom meet by chance.
    """
    shared = deltas.sparkSession.sparkContext.broadcast(common_keys(deltas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            for around, node, delta in zip(*batch.columns, strict=True):
                key = keyed(around.as_py(), delta.values.to_numpy().view(np.uint64))
                often, deal = np.zeros(len(key), np.int64), key
                if len(common):
                    at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    often = np.where(common[at] == key, counts[at], 0)
                    # a common element's deltas need not meet to be counted: they are dealt out by their own names
                    deal = np.where(often > 0, keyed(node.as_py(), key), key)
                yield _record("deal key often around node", deal.view(np.int64), key.view(np.int64), often, np.full(len(key), around.as_py()), np.full(len(key), node.as_py()))

    deltas = deltas.where(F.size("delta") > 0)
    rows = deltas.select("around", "node", "delta").mapInArrow(trimmed(run), "deal long, key long, often long, around long, node long")
    met = F.count("*").over(Window.partitionBy("deal"))
    rank = F.when(F.col("often") > 0, F.col("often") + (1 << 40)).otherwise(met)
    told = rows.select("key", "around", "node", rank.alias("rank")).where("rank > 1")
    # a delta that comes twice counts twice, with all its elements: a set drops them again, and the order stays one order
    others = told.groupBy("around", "node").agg(F.sort_array(F.collect_set(F.struct("rank", "key"))).alias("others"))
    each = deltas.select("around", "node", "size", F.col("most").cast("int").alias("most"), F.size("delta").alias("d")).distinct()
    alone = F.col("d") - F.size("others")
    first = others.join(each, ["around", "node"]).where(alone < F.col("most"))
    first = first.select("node", "size", "d", alone.alias("alone"), F.posexplode(F.slice("others", F.lit(1), F.col("most") - alone)).alias("at", "other"))
    return first.select(F.col("other.key").alias("key"), (F.col("alone") + F.col("at") + 1).alias("place"), "node", "size", F.col("d").cast("long").alias("d"))


def prefix_meetings(rows: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components whose prefixes meet as those of similar sets must.

    Of the rows that meet, those of the component that has most of them are not compared with each other.
    """
    now = label.select(F.col("node").alias("labelled"), "comp")
    rows = staged(rows.join(now, rows.node == now.labelled, "left").select("key", "place", "node", "size", "d", F.coalesce("comp", "node").alias("comp")), "ngram-met")
    sides = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"))
    sides = sides.where("comps > 1").select("key", F.col("main.comp").alias("main"))
    told = staged(rows.join(sides, "key"), "ngram-told")
    x = told.where("comp <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in ("place", "node", "size", "d", "comp")])
    y = told.select("key", "main", *[F.col(c).alias(f"y_{c}") for c in ("place", "node", "size", "d", "comp")])
    h = f"({100 - percent} * (x_size + y_size) div {100 + percent})"
    apart = F.expr("x_comp <> y_comp and (y_comp = main or x_node < y_node)")
    meet = F.expr(f"y_place <= floor((y_d - x_d + {h}) / 2) + 1 and x_place <= floor((x_d - y_d + {h}) / 2) + 1")
    met = x.join(y, "key").where(apart & meet & _reachable(percent, "x_size", "y_size"))
    found = staged(met.select(F.least("x_node", "y_node").alias("u"), F.greatest("x_node", "y_node").alias("v")).distinct(), "ngram-pairs")
    for done in (rows, told):
        discard(done)
    return found


def equal_classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Profiles of the documents, the classes of equal sets, and the names that several sets had (they have others now)."""
    clashing: frozenset[int] = frozenset()
    while True:
        prof = staged(profiles(docs, n, clashing), "ngram-profiles")
        grouped = prof.where("node is not null").groupBy("node").agg(
            F.min("check").alias("check"), F.max("check").alias("other"), F.min("n_shingles").alias("size"),
            F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "tkey", "bins")).alias("from"),
        )
        classes = staged(grouped, "ngram-classes")
        # about m * m / 2**65 of m sets
        new = {r["node"] for r in classes.where("check <> other").select("node").collect()}
        if not new:
            return prof, classes, clashing
        clashing |= new
        for done in (prof, classes):
            discard(done)


def bands_of(classes: DataFrame, percent: int) -> list[Band]:
    starts = band_starts(percent, classes.agg(F.max("size")).first()[0] or 0)
    number = F.lit(0)
    for start in starts[1:]:
        number = number + (F.col("size") >= start).cast("int")
    # a row for each band: their number is the logarithm of the largest size
    found = {r.band: r for r in classes.groupBy(number.alias("band")).agg(F.count("*").alias("sets"), F.avg("size").alias("mean")).collect()}
    bands = []
    for k, (low, after) in enumerate(zip(starts, starts[1:], strict=False)):
        sets, mean = (found[k].sets, found[k].mean) if k in found else (1, float(low))
        bands.append(allocate(low, after - 1, percent, sets, mean))
    return bands


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text), linked where |A & B| * 100 >= percent * |A | B|."""
    return classified(docs, n, percent).drop("tkey", "comp")


def components_of(docs: DataFrame, classes: DataFrame, n: int, percent: int, clashing: frozenset[int]) -> DataFrame:
    """(node, comp) of the classes that have links."""
    spark = docs.sparkSession
    index = bucket_rows(docs, n, percent, bands_of(classes, percent), clashing)
    links = bucket_links(index).groupBy("center", "node").agg(F.min("center_size").alias("center_size"), F.min("size").alias("size"), F.max("more").alias("more"))
    links = staged(links, "ngram-links")
    del index
    release(spark)

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    def named(ends: DataFrame, of: str, name: str) -> DataFrame:
        told = label.select(F.col("node").alias("__named"), F.col("comp").alias("__comp"))
        return ends.join(told, ends[of] == told["__named"], "left").withColumn(name, F.coalesce("__comp", of)).drop("__named", "__comp")

    ends = links.select(F.explode(F.array("center", "node")).alias("node"))
    sets = staged(exact_sets(docs, classes, ends, n, clashing), "ngram-sets")
    release(spark)
    # each set and its first center: large groups of copies are told by that
    tried = links.where(_reachable(percent, "size", "center_size")).groupBy("node").agg(F.min("center").alias("center")).select(*pair("center", "node")).distinct()
    edges = distances(maybe_near(tried, classes, percent), sets, percent).select("u", "v")
    label = components(edges)
    # the rest: members of a center of which some are in other components
    seen = staged(named(named(links, "node", "comp"), "center", "center_comp"), "ngram-seen")
    apart = seen.where("comp <> center_comp").select("center").distinct()
    rest = staged(seen.join(apart, "center").select("center", "node", "size", "more", "comp", "center_comp"), "ngram-rest")
    if not rest.isEmpty():
        around = distances(maybe_near(rest.select(F.col("center").alias("u"), F.col("node").alias("v")), classes, percent, ring=True), sets, percent, ring=True)
        near = around.where(is_near(percent, "d", "nu", "nv"))
        edges = staged(edges.unionByName(near.select("u", "v")).distinct(), "ngram-edges")
        label = components(edges)
        release(spark)
        told = rest.join(near.select(F.col("u").alias("center"), F.col("v").alias("node"), F.lit(True).alias("near")).distinct(), ["center", "node"], "left")
        far = staged(told.where("more and near is null").select("node").distinct(), "ngram-far")
        ring = staged(named(named(around.select(F.col("u").alias("center"), F.col("v").alias("node"), F.col("nv").alias("size"), is_near(percent, "d", "nu", "nv").alias("near")).distinct(), "node", "comp"), "center", "center_comp"), "ngram-ring")
        split = ring.where("not near and comp <> center_comp").select("center").distinct()
        about = ring.join(split, "center")
        about = bounded_broadcast(staged(about.select(F.explode(F.array("center", "node")).alias("node")).distinct(), "ngram-ends"), 16)
        in_rings = sets.join(about, "node")
        of_center = in_rings.select(F.col("node").alias("center"), F.col("elements").alias("ec"))
        delta = F.concat(F.array_except("elements", "ec"), F.array_except("ec", "elements"))
        from_center = ring.join(split, "center").join(in_rings, "node").join(of_center, "center").select(
            F.col("center").alias("around"), "node", "size", (F.floor(F.col("size") * (100 - percent) / percent) + 1).alias("most"), delta.alias("delta")
        )
        own = sets.join(bounded_broadcast(far, 16), "node").select(
            F.lit(0).cast("long").alias("around"), "node", F.size("elements").cast("long").alias("size"), (F.floor(F.size("elements") * (100 - percent) / 100) + 1).alias("most"), F.col("elements").alias("delta")
        )
        deltas = staged(from_center, "ngram-deltas")
        about_centers = staged(prefixes(deltas), "ngram-prefixes")
        discard(deltas)
        release(spark)  # before the next shuffle
        left = staged(crowded(own, percent).select("node"), "ngram-crowded")
        release(spark)
        own = own.join(bounded_broadcast(left, 16), "node").select(*own.columns)
        rows = staged(about_centers.unionByName(prefixes(own)), "ngram-prefixes")
        discard(about_centers)
        shared = rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("first")).where("rows > 1")
        met = staged(rows.join(shared.drop("rows"), "key"), "ngram-met")
        discard(rows)
        release(spark)
        if not met.isEmpty():
            first = named(named(met.where("first <> node").select("first", "node").distinct(), "node", "comp"), "first", "first_comp")
            first = first.where("comp <> first_comp").select(*pair("first", "node")).distinct()
            more = distances(maybe_near(first, classes, percent), sets, percent).select("u", "v")
            if not more.isEmpty():
                edges = edges.unionByName(more)
                label = components(edges)
            last = distances(maybe_near(prefix_meetings(met.drop("first"), label, percent), classes, percent), sets, percent).select("u", "v")
            if not last.isEmpty():
                label = components(edges.unionByName(last))
        discard(met)
    for done in (links, sets, rest, seen):
        discard(done)
    release(spark)
    return label


def classified(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """similarity_classes() with tkey, a hash of each row's text, and comp, a node of the row's component; null without words."""
    prof, classes, clashing = equal_classes(docs, n)
    label = components_of(docs, classes, n, percent, clashing)
    least = label.join(classes.select("node", "min_id"), "node").groupBy("comp").agg(F.min("min_id").alias("component_id"))
    linked = label.join(least, "comp").select("node", "comp", "component_id")
    ids = classes.select("node", "min_id").join(linked, "node", "left").select(F.col("node").alias("class"), F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "min_id").alias("component_id"))
    out = prof.join(ids, prof.node == F.col("class"), "left")
    return out.select("doc_id", "tkey", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "comp")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)
