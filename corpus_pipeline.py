"""From raw documents to token ids: five stages, each on all that the one before has kept.

1. language_id: documents of no language go (null texts, texts without a letter, and those with no clear language).
2. ngram_join: of each group of near duplicates (sets of five-word shingles, similarity 0.8 or more) the document with the
   smallest id stays, without any id one of them; documents without words stay.
3. suffix_dedup: bytes of strings of PASSAGE_BYTES or more that repeat are cut (so passages of over 50 words are); a character
   that loses some of its bytes goes.
4. mixing: sources are repeated towards flatter shares, by temperature, at most MAX_REPETITION times; none is cut.
5. byte_bpe: ids of each text, and their digests.

Each stage takes nulls in any column, empty and very long texts, repeated rows and empty tables (it returns none then).
Columns beyond doc_id, text, lang, source and n_chars, whatever their names are, pass all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import byte_bpe, language_id, mixing, ngram_join, suffix_dedup
from curatrix.llm.common import bounded_broadcast, masked, staged, table
from curatrix.llm.suffix_dedup import PASSAGE_BYTES

#: A document's language must have this posterior at least.
LEAST_LANGUAGE_SCORE = 0.5
#: Columns that stages use; others are carried past them.
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, empty ones and those without a letter go; where no language can be learned, all do."""
    docs, back = masked(docs, OWN)
    found = language_id.identify(docs, language_id.learn(docs))
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), [])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the smallest id's, or without any id the first by a hash of the text. Equal rows stay once."""
    docs, back = masked(docs, OWN)
    classes = staged(ngram_join.classified(docs.select("doc_id", "text"), n=5, percent=80), "pipeline-classes")
    alike = classes.groupBy("comp", "doc_id", "tkey").agg(F.count("*").alias("rows"))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("stay_id"), F.col("tkey").alias("stay_key"), "rows")
    first = alike.where("comp is not null").groupBy("comp").agg(F.min(row).alias("row")).select("row.*")
    wordless = alike.where("comp is null").select(row.alias("row")).select("row.*")
    stay = staged(first.unionByName(wordless).drop("nameless"), "pipeline-stay")
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    out = keyed.join(bounded_broadcast(stay, 32, 16 << 20), F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("__key") == F.col("stay_key")))
    if not stay.where("rows > 1").isEmpty():
        out = out.where("rows = 1").unionByName(out.where("rows > 1").dropDuplicates(["doc_id", "__key"]))
    return back(out, [])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts stay null. n_chars is counted anew where bytes are cut."""
    docs, back = masked(docs, OWN)
    found = suffix_dedup.without_repeats(docs, PASSAGE_BYTES, as_text=True)
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return back(found.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns]), [])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source of its own; texts without tokens go with their block."""
    docs, back = masked(docs, OWN)
    return back(mixing.mix(docs, max_repetition=mixing.MAX_REPETITION), [])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text counts as empty: no ids."""
    path, pattern = byte_bpe.default_ranks()
    return byte_bpe.digests(byte_bpe.encode_and_decode(docs.select("doc_id", "text"), path, pattern))


STAGES = [
    ("language_id", keep_languages),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses neither the language model nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
