"""Continuous flagging: gate, score, decide, and keep state by post. Every stage is the batch's column functions on a stream."""

from __future__ import annotations

import heapq
import itertools
import operator
import pickle
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from curatrix.functions.text import text_gate
from curatrix.sources.files import shared_path

#: Rows of one key that a task holds at once.
RUN_ROWS = 100_000
#: Where state lives: on disk, with only what changed written for a micro-batch.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files. A stream takes a single file by a pattern only."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def flag_posts(posts: DataFrame, text: str, score: Column, at: float) -> DataFrame:
    """Gated posts with their score and whether they are flagged."""
    gated = posts.withColumn("gated", text_gate(F.col(text))).where("gated is not null").drop("gated")
    return gated.withColumn("score", score).withColumn("flagged", F.col("score") >= at)


def in_order(rows: Iterator[Row], order: str, most: int | None = None) -> Iterator[Row]:
    """The rows by ascending order, ties as they came. `most` of them are held at once: more are sorted run by run on the task's own disk and merged."""
    most = most or RUN_ROWS
    place = operator.itemgetter(order)
    runs: list[BinaryIO] = []
    names: Row | None = None
    while True:
        run = sorted(itertools.islice(rows, most), key=place)
        if len(run) < most and not runs:
            yield from run
            return
        if run:
            names = Row(*run[0].__fields__)
            file = tempfile.TemporaryFile()
            for row in run:
                pickle.dump(tuple(row), file, pickle.HIGHEST_PROTOCOL)
            file.seek(0)
            runs.append(file)
        if len(run) < most:
            break

    def read(file: BinaryIO) -> Iterator[Row]:
        while True:
            try:
                yield names(*pickle.load(file))  # noqa: S301  own rows of this task
            except EOFError:
                file.close()
                return

    yield from heapq.merge(*map(read, runs), key=place)


class Changes(StatefulProcessor):
    """The state of a key is the value that it had last; with a time to live it ends that long after the key's last row."""

    def __init__(self, key: str, order: str, value: str, first: bool, at: str | None, keep_ms: int):
        self.key, self.order, self.value, self.first, self.at, self.keep_ms = key, order, value, first, at, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string, ends bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        had = self.last.get() if self.last.exists() else None
        known, value, ends = had is not None, had[0] if had else None, had[1] if had else None
        was = ends
        for row in in_order(rows, self.order):
            now = None if row[self.value] is None else str(row[self.value])
            if self.at and known and ends is not None and row["__at"] is not None and row["__at"] > ends:
                known = False  # over before, whether or not its timer has fired yet
            if now != value if known else self.first:
                yield Row(**{c: row[c] for c in (self.key, self.order, self.value)})
            known, value = True, now
            if self.at and row["__at"] is not None:
                ends = max(ends or 0, row["__at"] + self.keep_ms)
        self.last.update((value, ends))
        if self.at and ends is not None and ends != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(posts: DataFrame, key: str, order: str, value: str, first: bool = True, at: str | None = None, late: str = "0 seconds", keep: str = "7 days") -> DataFrame:
    """(key, order, value) of rows whose value is not the one seen last for the key; without `first`, a key's first value is no change.

    Rows of a micro-batch are walked one by one in their order, later batches after earlier ones. A key's state is one value, in
    a store on disk. With `at`, a time of the rows, a key's state ends `keep` after its last row, by the watermark, and the key
    begins anew; rows that come `late` behind the watermark count for nothing. Without it, state is kept until the query's is dropped.
    """
    spark = posts.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)
    kinds = {f.name: f.dataType.simpleString() for f in posts.schema.fields}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in (key, order, value))
    if at is None:
        rows, mode, keep_ms = posts.select(key, order, value), "none", 0
    else:
        rows, mode = posts.withWatermark(at, late).select(key, order, value, at, F.unix_millis(at).alias("__at")), "eventTime"
        keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy(key).transformWithState(Changes(key, order, value, first, at, keep_ms), out, "append", mode)


def run_to_table(stream: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Runs the stream over all that is there and returns what it appended; exactly once by the sink's log. With the `out` of an earlier run it goes on from there."""
    spark = stream.sparkSession
    out = out or shared_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_by_batches(stream: DataFrame, label: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Runs the stream through foreachBatch. A batch writes its own folder by number, so that writing it again changes nothing.

    A batch that fails (a broken file, a value that an expression can't take) is recorded with its files and its error in the
    quarantine (quarantined(out)), and the stream goes on with the next. Mode complete: the last batch is the result.
    """
    spark = stream.sparkSession
    out = out or shared_path(spark, label)
    fs, path = _folder(spark, out)

    def write(batch: DataFrame, number: int) -> None:
        try:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        except Exception as failure:  # noqa: BLE001  whatever it is, it is this batch's alone
            fs.delete(path(f"{out}/batch={number}"), True)
            row = [(number, type(failure).__name__, str(failure)[:2000])]
            spark.createDataFrame(row, "batch long, error string, message string").coalesce(1).write.mode("overwrite").json(f"{out}-quarantine/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [s.getPath().getName() for s in (fs.listStatus(path(out)) if fs.exists(path(out)) else [])]
    numbers = [int(n.split("=")[1]) for n in found if n.startswith("batch=")]
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(numbers)}" if mode == "complete" else f"{out}/batch=*")


def _folder(spark: SparkSession, out: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def quarantined(spark: SparkSession, out: str) -> DataFrame:
    """(batch, error, message, files) of batches that failed; their files can be read anew once they are mended."""
    kinds = "batch long, error string, message string"
    fs, path = _folder(spark, out)
    if not fs.exists(path(f"{out}-quarantine")):
        return spark.createDataFrame([], f"{kinds}, files array<string>")
    failed = spark.read.schema(kinds).json(f"{out}-quarantine/batch=*")
    # the source's log has a JSON line for each file that a batch took
    log = spark.read.text(f"{out}-log/sources/0/*").where(F.col("value").startswith("{"))
    taken = log.select(F.get_json_object("value", "$.batchId").cast("long").alias("batch"), F.get_json_object("value", "$.path").alias("file")).distinct()
    return failed.join(taken.groupBy("batch").agg(F.sort_array(F.collect_list("file")).alias("files")), "batch", "left")


def window_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """(start, kind, n) by tumbling windows; events later than `late` are dropped."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def rate_drift(events: DataFrame, at: str, kind: str, width: str, late: str, baseline: DataFrame, tolerance: float) -> DataFrame:
    """(start, kind, n, total, rate, baseline, drifted) of closed windows, for each kind of the baseline table (kind, rate), a row for each kind.

    A window is reported once, when the watermark has passed its end, and its state goes then; events of it that come later
    count for nothing. The rate of a kind is its share of the window's events; it drifts if it is off by more than the tolerance.
    """
    known = [(r[0], r[1]) for r in baseline.collect()]  # a row for each kind
    each = [F.count_if(F.col(kind) == k).alias(f"n{i}") for i, (k, _) in enumerate(known)]
    counts = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("total"), *each)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").alias("n"), F.lit(float(rate)).alias("baseline")) for i, (k, rate) in enumerate(known)])
    opened = counts.select(F.col("w.start").alias("start"), "total", F.explode(rows).alias("r")).select("start", F.col("r.kind").alias(kind), "r.n", "total", "r.baseline")
    rate = F.col("n") / F.col("total")
    return opened.withColumn("rate", rate).withColumn("drifted", F.abs(rate - F.col("baseline")) > tolerance)


def distinct_within(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each combination of keys once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def policy_action(score: Column, policy: list[tuple[str, float]], otherwise: str = "none") -> Column:
    """The first action of (action, least score), in order of severity."""
    out = F.lit(otherwise)
    for action, least in reversed(policy):
        out = F.when(score >= least, action).otherwise(out)
    return out


def near_threshold(rows: DataFrame, score: str, at: float, band: float) -> DataFrame:
    return rows.where(F.abs(F.col(score) - at) <= band)
