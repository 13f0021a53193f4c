"""Readers and writers of posts, labelled lines, id lists, change lists and snapshots.

Lines have no order of their own in Spark: where order matters, line_no comes from the file's position.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions.labels import constants, normalize_change_labels

POST = (
    "id string, platform string, source_id string, source_url string, collected_at string, text string, raw_text string, labels array<string>, label string, "
    "urls array<string>, addresses array<string>, notes string, author_handle string, label_source string, _corrupt string"
)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares; in a folder of our own where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: what was drawn stays as it is, whatever executors are lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones give no row, broken ones a row with _corrupt."""
    return spark.read.schema(POST).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_posts(posts: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = posts.write
    (writer.partitionBy(*by) if by else writer).json(path)


def parse_labeled(line: Column) -> Column:
    """struct(labels, text) of `__label__a __label__b text`; null if the line doesn't begin with a label."""
    one = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    head = F.regexp_extract(one, r"^((?:__label__\S+ ?)+)(.*)$", 1)
    labels = F.transform(F.filter(F.split(head, " "), lambda x: x != ""), lambda x: F.replace(x, F.lit("__label__"), F.lit("")))
    return F.when(one.startswith("__label__"), F.struct(labels.alias("labels"), F.regexp_extract(one, r"^((?:__label__\S+ ?)+)(.*)$", 2).alias("text")))


def read_labeled_text(spark: SparkSession, path: str, classes: list[str] | None = None, allow_empty: bool = False) -> DataFrame:
    """(labels, text); with classes, other labels go, and rows without any."""
    rows = spark.read.text(path).select(parse_labeled(F.col("value")).alias("p")).where("p is not null").select("p.*")
    if not allow_empty:
        rows = rows.where("text <> ''")
    if classes is not None:
        rows = rows.withColumn("labels", F.array_intersect("labels", constants(classes))).where(F.size("labels") > 0)
    return rows


def labeled_line(labels: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.transform(labels, lambda x: F.concat(F.lit("__label__"), x)), F.regexp_replace(text, r"(?U)\s+", " "))


def write_labeled_text(rows: DataFrame, path: str) -> None:
    """Rows without labels are left out."""
    rows.where(F.size("labels") > 0).select(labeled_line(F.col("labels"), F.col("text"))).write.text(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) once each: of JSON lines their id, of other lines the trimmed line."""
    line = F.trim("value")
    found = F.when(line.startswith("{"), F.get_json_object(line, "$.id")).otherwise(line)
    return spark.read.text(path).select(found.alias("id")).where("id is not null and id <> ''").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): line_no ascends with the lines of a file, and with files by name; it is a struct, not a dense number."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("line_no"))


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): line counts a file's lines from 1, blank ones too, in any number of splits.

    A split's rows are neighbours in one task, so a row's place in its split is its distance from the split's first row. One pass counts the
    lines of each split, sums before a split come from that table (a row for each split), and no line is moved.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    splits = staged(rows.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n")), "splits")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = splits.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(places, ["file", "start"]).select("value", "file", (F.col("row") + F.col("shift")).alias("line"))


def read_change_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, new_labels, valid) of lines `id label[ ,label]`; # begins a comment; the last line of an id holds."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "#.*$", ""))).where("value <> ''")
    parts = F.filter(F.split("value", r"[\s,]+"), lambda x: x != "")
    rows = lines.select(parts.alias("p"), "line_no").select(F.col("p")[0].alias("id"), F.slice("p", F.lit(2), F.size("p")).alias("new_labels"), "line_no")
    kept = rows.groupBy("id").agg(F.max_by("new_labels", "line_no").alias("new_labels"))
    return kept.withColumn("valid", F.size(normalize_change_labels(F.col("new_labels"))) > 0)


def read_snapshots(lines: DataFrame, value: str = "value") -> DataFrame:
    """(snapshot_id, retrieved_at, endpoint, post_id, raw): the envelope as columns, the payload as a variant."""
    parsed = lines.select(F.try_parse_json(value).alias("v")).where("v is not null")
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string").alias(path)
    return parsed.select(get("snapshot_id"), get("retrieved_at"), get("endpoint"), get("post_id"), F.try_variant_get("v", "$.raw", "variant").alias("raw"))


def snapshot_to_posts(snapshots: DataFrame) -> DataFrame:
    """Posts of payloads: the long text if there is one, author by id from the users included, edit ids from the oldest on,
    urls of text and long text (expanded ones, if told) once each, and referenced posts with their text if they are included."""
    get = lambda path, kind="string": F.try_variant_get("raw", f"$.{path}", kind)
    listed = lambda path, kind: F.coalesce(get(path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    users = get("includes.users", "array<struct<id:string,username:string>>")
    author = F.get(F.transform(F.filter(users, lambda u: u["id"] == F.col("author_id")), lambda u: u["username"]), 0)
    link = "struct<url:string,expanded_url:string>"
    links = F.concat(listed("data.entities.urls", link), listed("data.note_tweet.entities.urls", link))
    urls = F.array_distinct(F.array_compact(F.transform(links, lambda u: F.coalesce(u["expanded_url"], u["url"]))))
    others = listed("includes.tweets", "struct<id:string,text:string>")
    told = lambda r: F.get(F.transform(F.filter(F.col("others"), lambda t: t["id"] == r["id"]), lambda t: t["text"]), 0)
    references = F.transform(F.col("referred"), lambda r: F.struct(r["type"].alias("type"), r["id"].alias("id"), told(r).alias("text")))
    rows = snapshots.withColumns({"author_id": get("data.author_id"), "others": others, "referred": listed("data.referenced_tweets", "struct<id:string,type:string>")})
    return rows.select(
        get("data.id").alias("id"), F.coalesce(get("data.note_tweet.text"), get("data.text")).alias("text"), get("data.created_at").alias("created_at"),
        F.lower(author).alias("handle"), get("data.public_metrics.like_count", "long").alias("likes"), "retrieved_at",
        listed("data.edit_history_tweet_ids", "string").alias("history"), urls.alias("urls"), references.alias("refers"),
    )


def write_report(metrics: DataFrame, path: str, form: str = "json") -> None:
    (metrics.write.option("header", True).csv if form == "csv" else metrics.write.json)(path)
