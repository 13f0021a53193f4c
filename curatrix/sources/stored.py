"""Files as they lie in a store: written whole, digested in chunks, audited against a manifest; and an index of dataset snapshots.

Names that begin with _ or . are files in the making: neither Spark nor these functions list them.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.counts import fingerprint
from curatrix.sources.files import staged

#: Bytes of a file that a task holds at once, and bytes of files that one task digests.
CHUNK_BYTES, TASK_BYTES = 4 << 20, 256 << 20

DIGEST = "path string, length long, sha256 string"
ENTRY = "number long, snapshot_id string, name string, digest string, created_at string, tables array<struct<name:string,path:string,n_rows:long,digest:string>>"


def _store(spark: SparkSession, root: str):
    """The Hadoop file system of root, and what makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_files(rows: DataFrame, root: str, path: str = "path", part: str = "part", content: str = "content") -> DataFrame:
    """Writes each path's contents (text or binary, null: nothing) in the order of part as one file under root; (path, length, sha256) of them.

    A task streams its files, each under a hidden name until it is whole, so that a lost or repeated task leaves no half of a file.
    A file that is there already is replaced. Rows without a path are left out; one with equal parts has them in the order of content.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        now, out, hidden, size, digest = None, None, None, 0, None

        def finish():
            out.close()
            store.move(hidden, f"{top}/{now}")
            return pa.RecordBatch.from_pydict({"path": [now], "length": [size], "sha256": [digest.hexdigest()]})

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        yield finish()
                    folder, _, last = f"{top}/{name}".rpartition("/")
                    store.create_dir(folder, recursive=True)
                    now, hidden, size, digest = name, f"{folder}/_{uuid.uuid4().hex}-{last}", 0, hashlib.sha256()
                    out = store.open_output_stream(hidden, compression=None)
                out.write(value)
                digest.update(value)
                size += len(value)
        if now is not None:
            yield finish()

    told = rows.select(F.col(path).alias("path"), F.col(part).alias("part"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")).where("path is not null")
    ordered = told.repartition("path").sortWithinPartitions("path", "part", "content").select("path", "content")
    return staged(ordered.mapInArrow(write, DIGEST), "written")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, length) of all under root, paths from root on: kind is file, folder, or empty folder. No file is opened.

    Folders are listed level by level, each by a task of its own; the driver learns how many there are. (A scan of Spark's leaves out
    empty files.)
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                there = [x for x in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))) if x.base_name[0] not in "_."]
                inside = [f"{folder}/{x.base_name}".lstrip("/") for x in there]
                kinds = ["file" if x.type == fs.FileType.File else "folder" for x in there]
                sizes = [x.size if x.type == fs.FileType.File else None for x in there]
                if not there and folder:
                    inside, kinds, sizes = [folder], ["empty folder"], [None]
                yield pa.RecordBatch.from_arrays([pa.array(inside, pa.string()), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64())], ["path", "kind", "length"])

    found, level, n = None, spark.createDataFrame([("",)], "path string"), 1
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        one = staged(level.select("path").repartition(tasks, "path").mapInArrow(listed, "path string, kind string, length long"), "listed")
        found = one if found is None else found.unionByName(one)
        level = one.where("kind = 'folder'")
        n = level.count()
    return found


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of all files under root, of any size: read in chunks, so that a task's memory doesn't grow with them.

    SHA-256 goes from a file's first byte to its last, so a file is one task's; tasks are as many as the files' bytes need. The
    length is that of what was read.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with store.open_input_file(f"{top}/{name}") as file:
                    while chunk := file.read(CHUNK_BYTES):
                        digest.update(chunk)
                        size += len(chunk)
                yield pa.RecordBatch.from_pydict({"path": [name], "length": [size], "sha256": [digest.hexdigest()]})

    files = list_tree(spark, root).where("kind = 'file'")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, max(size // TASK_BYTES + 1, spark.sparkContext.defaultParallelism)))
    # a number of tasks of our own: the list is small, and Spark would take it for little work
    return files.select("path").repartition(tasks, "path").mapInArrow(digests, DIGEST)


def audit_files(manifest: DataFrame, files: DataFrame, largest: int = 30 << 20, model: str = r"^model/.*\.(onnx|bin|ftz)$") -> DataFrame:
    """(path, problem) of manifest (path, size_bytes, sha256) against files (path, length, sha256), a row for each problem.

    bad path: the manifest names a place outside of the root, and nothing else is told of it. A manifest row without a path is a bad path as
    well. size differs and digest differs are told apart; too large is for paths that match `model` only. Repeated manifest rows are judged each.
    """
    outside = F.col("path").isNull() | F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    real = files.select(F.col("path").alias("real"), "length", F.col("sha256").alias("found"))
    both = manifest.where(~outside).join(real, F.col("path") == F.col("real"), "full_outer")
    there = F.col("real").isNotNull() & F.col("path").isNotNull()
    problems = F.array_compact(F.array(
        F.when(F.col("real").isNull(), "missing"), F.when(F.col("path").isNull(), "untracked"),
        F.when(there & ~F.col("size_bytes").eqNullSafe(F.col("length")), "size differs"), F.when(there & ~F.col("sha256").eqNullSafe(F.col("found")), "digest differs"),
        F.when(there & F.col("real").rlike(model) & (F.col("length") > largest), "too large"),
    ))
    return both.select(F.coalesce("path", "real").alias("path"), F.explode(problems).alias("problem")).unionByName(manifest.where(outside).select("path", F.lit("bad path").alias("problem")))


def publish(spark: SparkSession, text: str, path: str) -> bool:
    """Writes text as a new file, whole at once; False, and nothing changes, if another writer has made that file."""
    store, make = _store(spark, path)
    folder, _, name = path.rpartition("/")
    hidden = make(f"{folder}/_{uuid.uuid4().hex}-{name}")
    out = store.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        return _rename_new(spark, store, hidden, make(path))
    finally:
        store.delete(hidden, False)


def _rename_new(spark: SparkSession, store, hidden, final) -> bool:
    if store.getUri().getScheme() == "file":  # a rename would replace a file here; a link doesn't
        try:
            os.link(hidden.toUri().getPath(), final.toUri().getPath())
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hidden, final, none)
    except Py4JJavaError as failure:
        if "FileAlreadyExistsException" in failure.java_exception.toString():
            return False
        raise
    return True


def snapshot_index(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all snapshots under root (ENTRY), in the order of number."""
    store, make = _store(spark, root)
    folder = f"{root}/index"
    if not store.exists(make(folder)):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(folder)


def _next_id(index: DataFrame, name: str) -> str:
    """name, or name-v2, name-v3, ...: the first that no snapshot bears."""
    spark = index.sparkSession
    tries = spark.range(1, index.count() + 2).select("id", F.when(F.col("id") == 1, F.lit(name)).otherwise(F.concat(F.lit(f"{name}-v"), F.col("id").cast("string"))).alias("snapshot_id"))
    return tries.join(index, "snapshot_id", "left_anti").agg(F.min_by("snapshot_id", "id")).first()[0]


def append_snapshot(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame]) -> tuple[Row, bool]:
    """The index entry of these tables, and whether it is new. Tables that a snapshot holds already, in whatever order of rows, are not stored again.

    Rows are written to a folder of their own, read back and digested; then the entry is published under the next free number. If
    another writer takes that number first, index and digest are looked at again: of two writers with the same tables one appends,
    of two with the same name the later one's id gets -v2. What a writer that fails leaves behind is in no entry.
    """
    folder, parts = f"{root}/data/{uuid.uuid4().hex}", []
    for table, rows in sorted(tables.items()):
        path = f"{folder}/{table}"
        rows.write.parquet(path)
        kept = spark.read.schema(rows.schema).parquet(path)
        cells = kept.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(kept.columns)]), {"ignoreNullFields": "false"}).alias("row"))
        one = fingerprint(cells, ["row"]).first()
        parts.append((table, path, one["n_rows"], f"{one['digest_sum']}:{one['digest_xor']}"))
    digest = hashlib.sha256("|".join(f"{t}:{n}:{d}" for t, _, n, d in parts).encode()).hexdigest()
    store, make = _store(spark, root)
    store.mkdirs(make(f"{root}/index"))
    while True:
        index = snapshot_index(spark, root)
        same = index.where(F.col("digest") == digest).first()
        if same is not None:
            store.delete(make(folder), True)  # our own copy, which no entry names
            return same, False
        number = (index.agg(F.max("number")).first()[0] or 0) + 1
        at = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        entry = spark.createDataFrame([(number, _next_id(index, name), name, digest, at, parts)], ENTRY)
        if publish(spark, entry.select(F.to_json(F.struct(*entry.columns))).first()[0] + "\n", f"{root}/index/{number:09d}.json"):
            return entry.first(), True


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str, table: str) -> DataFrame:
    """The rows of one table of a snapshot."""
    found = snapshot_index(spark, root).where(F.col("snapshot_id") == snapshot_id).select(F.explode("tables").alias("t")).where(F.col("t.name") == table).select("t.path").first()
    if found is None:
        raise ValueError(f"no table {table} in a snapshot {snapshot_id}")
    return spark.read.parquet(found[0])
