"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch: whole texts ride in them, and a Python worker holds several.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session has no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own where it is unset (local runs)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of tables that nothing refers to: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that new ones replace; names compare as Spark's do, without case."""
    new = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def masked(df: DataFrame, keep: list[str]) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """df with all columns but those in keep under names that no operator uses, and the function that gives them their names back.

    back(out, new) has the columns of df, but those that new ones replace, and then the new ones.
    """
    bounded_batches(df.sparkSession)
    names = {c: f"__user{k}" for k, c in enumerate(df.columns) if c not in keep}

    def back(out: DataFrame, new: list[str]) -> DataFrame:
        gone = {n.lower() for n in new}
        return out.select([F.col(f"`{names.get(c, c)}`").alias(c) for c in df.columns if c.lower() not in gone] + [F.col(f"`{n}`") for n in new])

    return df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]), back


def drawn_by_class(rows: DataFrame, label: str, classes: list[int], most: int, keys: list[str]) -> DataFrame:
    """Of the distinct rows, `most` of each class at most: the first by a hash of keys. Each task keeps its own first ones, so no task sees a whole class."""
    rows = rows.distinct()
    out = None
    for c in classes:
        first = rows.where(F.col(label) == c).orderBy(F.xxhash64(*keys), *keys).limit(most)
        out = first if out is None else out.unionByName(first)
    return out


def with_columns_from_batches(
    df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list]], fields: list[T.StructField]
) -> DataFrame:
    """Appends columns that Python computes a batch at a time.

    make() runs once in each task and returns the function from the input arrays to the new arrays.
    Columns of df that have a new column's name are replaced.
    """
    bounded_batches(df.sparkSession)
    keep = without(df, [f.name for f in fields])
    own = uuid.uuid4().hex  # so that no column of the user's has the name of an input's copy
    marked = keep.select("*", *[df[f"`{c}`"].alias(f"__in{k}_{own}") for k, c in enumerate(inputs)])
    names, extra = keep.columns, len(inputs)
    schema = T.StructType([*keep.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in by_bytes(batch):
                columns = piece.columns
                new = step(*columns[len(columns) - extra :])
                yield pa.RecordBatch.from_arrays([*columns[: len(columns) - extra], *new], names=[*names, *[f.name for f in fields]])

    return marked.mapInArrow(trimmed(run), schema)


def by_bytes(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, one row at least: very long texts don't pile up."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
        return
    step = max(1, int(batch.num_rows * most / batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving free memory back to the system at a task's end: workers stay, idle, beside those of later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # other C libraries have no such call
                pass

    return wrapped


def small_enough(df: DataFrame, row_bytes: int, most: int = 8 << 20) -> bool:
    """Whether a staged table of rows of a known width stays under a bound, so that it may be broadcast."""
    return df.limit(most // row_bytes + 1).count() * row_bytes <= most


def bounded_broadcast(df: DataFrame, row_bytes: int, most: int = 8 << 20) -> DataFrame:
    """df with a broadcast hint if its measured size is under the bound, else df as it is: Spark then shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes, most) else df
