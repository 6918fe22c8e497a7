"""A corpus pipeline over documents: five stages, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import decontaminate, jaccard, langid, lines, sentencepieces
from concordat.llm.queries import END_ID, PIECES, language_model
from concordat.session import materialize, scratch_scope

#: A text whose best language has less than this is no text in a known language.
MIN_LANGUAGE_SCORE = 0.3

#: Null ids can't be told apart, so such rows are never dropped as copies.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go. A missing ``lang`` becomes the predicted one."""
    found = langid.label(docs, language_model(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left."""
    found = lines.dedup_lines(docs)
    kept = found.where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, and of
    all that such links join, the one with the smallest id stays. Rows are known
    by id and text: of repeated rows one stays, and a row that shares only its
    id with a copy isn't touched."""
    row = F.struct("doc_id", F.xxhash64("text").alias("t"))
    rows = docs.withColumn("_row", row)
    known = rows.where("doc_id is not null").select("_row", "text")
    keys = lambda df, label: materialize(df.select(F.col("doc").alias("_row")).distinct(), label, result=True)
    with scratch_scope(spark):
        found = jaccard.link_sets(known, doc="_row", words=5, threshold=(80, 100)).select("doc", "component")
        gone = keys(found.where("component <> doc"), "copies")
        again = keys(found.groupBy("doc").count().where("count > 1"), "repeats")
    kept = rows.join(gone, "_row", "left_anti")
    once = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(again, "_row", "left_anti").unionByName(once).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether these give the text back. Ids
    are written in between: else each task holds two workers."""
    ids = materialize(sentencepieces.encode(docs, PIECES, end_id=END_ID), "ids", compression="zstd")
    both = sentencepieces.decode(ids, PIECES)
    return both.withColumns({"n_tokens": F.size("ids").cast("long"), "lossless": F.col("decoded") == F.coalesce("text", F.lit(""))}).drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"), result=True)
    return docs


#: A learned model and edit distances over all lines can't be said in SQL; the
#: stages are tested against brute force.
ORACLE_SQL = None
