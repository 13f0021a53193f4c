"""Clusters of near-duplicate posts: banded min-hashes, an exact join of what they leave apart, and connected components.

A post's set are its distinct five-word shingles (fewer words: all of them as one), as 64-bit hashes. Equal texts are one
to begin with. Each hash falls into one of BANDS x ROWS bins by its low bits; the least hash of each bin is the signature (a one-permutation
min-hash), ROWS bins a band, and posts whose bands agree meet in a bucket. A post's bands are told where its set is read; only
they are dealt out, and the sets that pairs name. Nothing is held by the driver or by one task.

Members of a bucket are compared with a center, not with each other; centers differ by band. Those that are no near
duplicates of it form the bucket's next round, with a center among them. Two posts of similarity J agree in a band with
probability J ** ROWS about, so a pair at the threshold of 0.8 meets in some of the 16 bands with probability 0.998. Pairs that are
reported are always checked on whole sets.

What bands and ROUNDS rounds leave apart is then found exactly (left_apart), so clusters are those of all pairs. Only pairs of unlike
components are of use by then. A set may have a fifth of its elements for itself at most to be similar to any; only sets that pass this are dealt
out. Elements that a component has for itself come first in their order, then rare ones, common ones last; two similar sets of unlike
components share an element within the first size - ceil(0.8 x size) + 1. Sets that do are compared, unless what these beginnings share and what is left is too little.

Buckets and centers of any size are spread: rows of a bucket by a salt, pairs of a center by its number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.plans.components import components
from curatrix.sources.files import staged

#: Words of a shingle, and the similarity from which posts are near duplicates.
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, ROUNDS = 16, 5, 4
#: Tasks that a bucket's rows are spread over; pairs of a center that stay together; copies from which a text counts as hot.
SALTS, CENTER_PAIRS, HOT_COPIES = 8, 1000, 100_000
#: Rows of digests (32 bytes, and a key at most) that are broadcast; bytes of hashes that a task works through at once.
FEW, BATCH_BYTES = 400_000, 4 << 20
#: Sets are first held against each other by so many times the share of elements that two similar ones may differ in.
ALONE_SHARE = 2


def shingled(posts: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """posts with `hashes`, the distinct 64-bit hashes of a text's shingles, in place of the text; none for null texts and texts without words."""
    found = posts.withColumn("__words", F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))
    one = lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(words)])
    long = F.when(F.size("__words") >= words, F.transform(F.sequence(F.lit(0), F.size("__words") - words), one))
    short = F.when(F.size("__words") > 0, F.array(F.xxhash64("__words")))
    return found.withColumn("hashes", F.array_distinct(F.coalesce(long, short, F.array().cast("array<bigint>")))).drop("__words", text)


def bands(sets: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, size, band, bucket): of each band that has a hash, a digest of its bins' least hashes. Told where a set is read: hashes don't move."""
    bins = n_bands * rows
    bounded = "spark.sql.execution.arrow.maxBytesPerBatch"
    if sets.sparkSession.conf.get(bounded, None) is None:
        sets.sparkSession.conf.set(bounded, str(BATCH_BYTES))
    # a second hash orders a bin's members: what put them into the bin doesn't
    hashed = sets.select("key", "hashes", F.transform("hashes", lambda h: F.xxhash64(h, F.lit(1))).alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                h, order = (pc.list_flatten(batch.column(k)).to_numpy(zero_copy_only=False) for k in (1, 2))
                own = np.repeat(np.arange(len(size)), size) * bins + h % bins
                at = np.lexsort((order, own))
                own, order = own[at], order[at]
                least = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                own, order = own[least], order[least].view(np.uint64)
                mixed = _mixed(order ^ _mixed((own % bins + 1).astype(np.uint64)))
                band = own // rows  # of all rows: a set has n_bands of them
                first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]][: len(band)])
                bucket = np.bitwise_xor.reduceat(mixed, first) if len(first) else mixed
                row = band[first] // n_bands
                columns = [batch.column(0).take(pa.array(row)), pa.array(size[row], pa.int32()), pa.array(band[first] % n_bands, pa.int32()), pa.array(bucket.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "band", "bucket"])

    return hashed.mapInArrow(run, T.StructType([sets.schema["key"], *T._parse_datatype_string("size int, band int, bucket long").fields]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def at_most(rows: DataFrame, most: int) -> bool:
    """Whether a staged table has so many rows at most, so that it may be broadcast."""
    return rows.limit(most + 1).count() <= most


def named_by(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that pairs (staged) name, staged: those are few, and the others stay where they are as long as the names may be broadcast."""
    names = staged(pairs.select(F.explode(F.array("member", "center")).alias("key")).distinct(), "near-names")
    return staged(sets.join(F.broadcast(names) if at_most(names, FEW) else names, "key", "left_semi"), "near-named")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (member, center; staged) whose sets are similar. The pairs of a center are dealt out to as many tasks as they need."""
    sets = named_by(pairs, sets)
    salts = pairs.groupBy("center").agg(F.ceil(F.count("*") / CENTER_PAIRS).cast("int").alias("salts"))
    dealt = pairs.join(salts, "center").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int")).drop("salts")
    middle = sets.join(salts, F.col("key") == F.col("center")).select("center", F.col("hashes").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = sets.select(F.col("key").alias("member"), F.col("hashes").alias("a"))
    shared = F.size(F.array_intersect("a", "b"))
    return dealt.join(own, "member").join(middle, ["center", "salt"]).where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("member", "center")


def met(sets: DataFrame, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(member, center): near duplicates that share a bucket; not all of them, nor are they all in one component. sets as in links."""
    open_ = staged(bands(sets, n_bands, rows), "near-bands")
    found = []
    for _ in range(rounds):
        order = F.struct(F.xxhash64("key", "band").alias("o"), F.col("key").alias("center"), F.col("size").alias("center_size"))
        centers = open_.groupBy("band", "bucket").agg(F.min(order).alias("c"), F.count("*").alias("n")).where("n > 1")
        spread = centers.select("band", "bucket", "c.center", "c.center_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows_ = open_.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(spread, ["band", "bucket", "salt"]).where("key <> center")
        rows_ = staged(rows_.select("key", "size", "band", "bucket", "center", "center_size"), "near-members")
        # sets of unlike sizes can't be similar
        alike = F.least("size", "center_size") >= similarity * F.greatest("size", "center_size")
        pairs = staged(rows_.where(alike).select(F.col("key").alias("member"), "center").distinct(), "near-pairs")
        good = staged(checked(pairs, sets, similarity), "near-links")
        found.append(good)
        done = good.select(F.col("member").alias("key"), "center")
        open_ = staged(rows_.join(done, ["key", "center"], "left_anti").select("key", "size", "band", "bucket"), "near-open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).distinct()


def spare(size: Column, similarity: float) -> Column:
    """How many of its elements a set's similar partner may lack."""
    return F.floor((1 - similarity) * size + 1e-9)  # never one too few by rounding: what is told by it is checked


def alone(sets: DataFrame, similarity: float) -> DataFrame:
    """(key) of sets that are similar to no other: in a part of all hashes, which is the same for all, too many of their elements are in no other set."""
    part = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(1000)) < min(1000, round(1000 * ALONE_SHARE * (1 - similarity)))
    own = sets.select("key", F.explode("hashes").alias("h")).where(part).groupBy("h").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n = 1")
    many = own.groupBy("key").agg(F.count("*").alias("n"))
    return many.join(sets.select("key", F.size("hashes").alias("size")), "key").where(F.col("n") > spare(F.col("size"), similarity)).select("key")


def left_apart(sets: DataFrame, same: DataFrame, similarity: float) -> DataFrame:
    """(member, center): a pair of near duplicates for each two components (same: node, root) that have any. sets as in links."""
    lone = staged(alone(sets, similarity), "near-alone")
    rest = sets.where(F.size("hashes") > 0).join(F.broadcast(lone) if at_most(lone, FEW) else lone, "key", "left_anti")
    roots = rest.select("key").join(same.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    rest = staged(rest.select("key", "hashes").join(roots, "key"), "near-rest")
    held = rest.select("key", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    # elements of one component alone tell it from all others, as those of one set do
    counts = held.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h", "n")
    ordered = held.join(counts, "h").groupBy("key", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("order"))
    ordered = ordered.withColumns({"before": F.col("size") - F.size("order"), "width": spare(F.col("size"), similarity).cast("int") + 1}).where("before < width")
    first = ordered.withColumn("order", F.slice("order", F.lit(1), F.col("width") - F.col("before")))
    first = staged(first.select("key", "root", "size", "before", "width", F.element_at("order", -1).alias("last"), F.col("order.h").alias("ahead")), "near-ahead")
    at = first.select("key", "root", "size", "before", F.posexplode("ahead").alias("place", "h")).withColumn("left", F.col("size") - F.col("before") - F.col("place"))
    x, y = (at.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "size", "left")]) for side in "xy")
    # from the first element that two sets share, they can share no more than either has left
    enough = lambda most: most * (1 + similarity) + 1e-9 >= similarity * (F.col("size_x") + F.col("size_y"))
    pairs = staged(x.join(y, "h").where((F.col("root_x") < F.col("root_y")) & enough(F.least("left_x", "left_y"))).select("key_x", "key_y").distinct(), "near-meeting")
    # of the set whose beginning ends first, they share what both beginnings have, and no more than what it has left
    x, y = (first.select(*[F.col(c).alias(f"{c}_{side}") for c in ("key", "size", "width", "last", "ahead")]) for side in "xy")
    most = F.size(F.array_intersect("ahead_x", "ahead_y")) + F.when(F.col("last_x") <= F.col("last_y"), F.col("size_x") - F.col("width_x")).otherwise(F.col("size_y") - F.col("width_y"))
    pairs = pairs.join(x, "key_x").join(y, "key_y").where(enough(most)).select(F.col("key_x").alias("member"), F.col("key_y").alias("center"))
    good = checked(staged(pairs, "near-apart"), rest.drop("root"), similarity)
    of = lambda side: rest.select(F.col("key").alias(side), F.col("root").alias(f"{side}_root"))
    one = good.join(of("member"), "member").join(of("center"), "center").groupBy("member_root", "center_root").agg(F.min(F.struct("member", "center")).alias("p"))
    return one.select("p.member", "p.center")


def links(sets: DataFrame, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(member, center): near duplicates whose components are those of all pairs. sets: (key, hashes), staged, keys distinct."""
    first = staged(met(sets, similarity, n_bands, rows, rounds), "near-met")
    return first.unionByName(left_apart(sets, components(first, "member", "center"), similarity))


def near_duplicate_clusters(posts: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(key, cluster, n): one row for each post with a key; cluster is the smallest key that near duplicates lead to, n the posts in it.

    Posts without words are clusters of their own, one for each; a key that is there twice counts once for each text.
    """
    rows = posts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    worded = rows.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))
    digest = F.unhex(F.sha2("text", 256))
    texts = worded.groupBy(digest.alias("digest")).agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    texts = staged(texts, "near-texts")
    # a text's own row is read where it is: its first key's, so that no text moves for a group of copies; nor does one without a copy
    marked, copied = worded.withColumn("digest", digest), staged(texts.where("copies > 1").select("digest", F.col("first").alias("key")), "near-copied")
    if at_most(copied, FEW):
        firsts = marked.join(F.broadcast(copied.select("digest")), "digest", "left_anti").select("digest", "text")
        again = marked.join(F.broadcast(copied), ["digest", "key"])
    else:
        firsts, again = None, marked.join(texts.select("digest", F.col("first").alias("key")), ["digest", "key"])
    again = again.dropDuplicates(["key", "digest"]).select("digest", "text")
    firsts = again if firsts is None else firsts.unionByName(again)
    # sets go by numbers, a fourth of a digest: what is told of elements by the million carries them
    sets = staged(shingled(firsts.withColumn("key", F.monotonically_increasing_id()), "text").select("digest", "key", "hashes"), "near-sets")
    same = components(links(sets.select("key", "hashes"), similarity), "member", "center")
    known = sets.select("digest", "key").join(same.withColumnRenamed("node", "key"), "key", "left").select("digest", F.coalesce("root", "key").alias("root"))
    found = texts.join(known, "digest")
    total = found.groupBy("root").agg(F.min("first").alias("cluster"), F.sum("copies").alias("n"))
    known = staged(found.join(total, "root").select("digest", "cluster", "n", "copies"), "near-known")
    own = worded.select("key", digest.alias("digest"))
    hot = known.where(F.col("copies") > HOT_COPIES).drop("copies")  # a row for HOT_COPIES rows at most
    other = known.where(F.col("copies") <= HOT_COPIES).drop("copies")
    out = own.join(F.broadcast(hot), "digest").unionByName(own.join(F.broadcast(hot), "digest", "left_anti").join(other, "digest"))
    wordless = rows.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")).select("key", F.col("key").alias("cluster"), F.lit(1).cast("long").alias("n"))
    return out.select("key", "cluster", "n").unionByName(wordless).withColumnRenamed("key", key)
