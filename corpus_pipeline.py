"""The corpus pipeline: what a training set is made of, stage by stage.

1. ``quality``: documents that the positive-unlabelled classifier rejects go;
2. ``near_duplicates``: one document of each group of near copies stays (five words
   a shingle, similarity 0.8 or more);
3. ``secrets``: every secret in the texts that stay is masked; no document goes;
4. ``packing``: the pieces of the documents that stay, placed in sequences.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next one's ``docs``.  The first three return the columns of ``docs``,
whatever they are; the last returns a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import new_folder, table
from rostercast.llm.fit_packing import pack_documents
from rostercast.llm.minhash_dedup import near_duplicates
from rostercast.llm.pu_quality import keep_good
from rostercast.llm.random_secrets import redact

SHINGLE_WORDS, SIMILAR = 5, 80
ROW = "_row_of_id_and_text"
STORED = 150_000  # words whose ids a worker keeps: here it shares an executor with what the stages before have left


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; without trusted positives all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without an id or without words all stay.

    Rows that repeat an id and its text are one document; rows of one id with different texts are
    documents of their own, by a 64-bit hash of both, which also decides between them in a group.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    groups = near_duplicates(docs.select(row.alias(ROW), "text"), key=ROW, words=SHINGLE_WORDS, share=SIMILAR)
    groups = groups.where("doc_id is not null").select(F.col("doc_id").alias(ROW), "component_id").distinct()
    ids = docs.where("doc_id is not null").select("doc_id", row.alias(ROW)).distinct()
    kept = ids.join(groups, ROW).groupBy("component_id").agg(F.min(F.struct("doc_id", ROW)).alias("least")).select(f"least.{ROW}")
    unnamed = docs.where("doc_id is null")
    named = docs.where("doc_id is not null").withColumn(ROW, row).join(kept, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)
    return named.unionByName(unnamed).select(*[F.col(f"`{c}`") for c in docs.columns])


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, ``n_chars`` as the texts now are."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return pack_documents(docs, stored=STORED)


STAGES = [("quality", quality), ("near_duplicates", one_of_each), ("secrets", masked), ("packing", packed)]

# the classifier, the randomness tests and the tokenizer are not SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
