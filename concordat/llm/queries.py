"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import chat, decontaminate, divergence, jaccard, langid, lempelziv, license_sql, licenses, lines, prefixtrie, quantised, sentencepieces, tokenfile, webpages
from concordat.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepieces.encode(docs, PIECES, end_id=END_ID, keep_text=False)
    return sentencepieces.decode(ids, PIECES).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the labelled documents that are not held out."""
    return langid.fit(docs.where(~held_out()), key=F.col("doc_id"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.label(docs.select("doc_id", "text"), language_model(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_spans")


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.link_sets(table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"))


def byte_bpe() -> tuple[str, bytes, str]:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as g:
        return f.read(), g.read(), public_tokenizers.PATTERN


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.scratch(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), path, byte_bpe(), end_id=0)
    return tokenfile.crc_of_ids(tokenfile.read(spark, path), ["doc", "start"]).withColumnRenamed("doc", "doc_id")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


@query("op6_license_scan", license_sql.SQL)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("templates", lambda t: t["sure"])
    base, more = F.array_sort(F.array_distinct("phrases.label")), F.concat(sure["label"], "notices.label")
    n = F.size("phrases")
    return found.select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"), F.array_max("phrases.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce(F.array_max(F.concat(sure["containment"], "notices.containment")), F.lit(0.0))).alias("score"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.with_neighbour(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query("op9_chat_collapse", chat.SQL)
def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.collapse(table(spark, sf_dir, "conversations"))
    return found.withColumnRenamed("conv", "conv_id")


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webpages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_near_vectors", quantised.SQL)
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantised.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnsRenamed({"vec": "vec_id", "component": "component_id"})


@query("op13_source_divergence", divergence.SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefixtrie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixtrie.trie(table(spark, sf_dir, "conversations"))
    return found.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id", "n": "n_convs", "children": "n_children",
                                     "leaves": "n_leaves", "saved": "saved_tokens", "ends_sha": "ends_sha256"})
