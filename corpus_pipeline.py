"""A training-corpus pipeline of five stages, each one of the operators in ``ferret.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

1. quality_classifier: documents whose quality score is below ``ACCEPT`` go. Where the labels outside the held-out fold are
   none or of one class, no model can be fitted and all documents stay.
2. line_dedup: lines that repeat an earlier one, or are one word edit from it, go; a document that loses all its
   lines goes, one without any line from the start stays. n_chars follows the text.
3. jaccard_join: of the documents that chains of 80 % similar five-word shingle sets connect, the one with the least
   doc_id stays. Of rows that share a doc_id, the one with the least text hash stays; rows without a doc_id are told apart by
   their texts and count as later than all others.
4. mix_sources: documents that the mix does not take go, those that it takes k times come k times.
5. sentencepiece: adds ids and n_tokens.

Stages bound the session's Arrow batches to 4 MB and let the shuffle files of a query go when it ends.

Null texts and ids, empty tables and extra columns pass through as the operators define. SQL cannot express the
learned classifier, so ``ORACLE_SQL`` is None; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferret.llm.common import lean_session, scratch, stage
from ferret.llm.jaccard_join import near_duplicates
from ferret.llm.line_dedup import dedup_lines
from ferret.llm.mixing import mix_sources
from ferret.llm.quality_classifier import ACCEPT, score_quality
from ferret.llm.sentencepieces import encode_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_session(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, docs, labels, score="__quality", unfitted=1.0)
    return scored.where(F.col("__quality") >= ACCEPT).drop("__quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_session(spark)
    out = dedup_lines(docs, prefix="__").where("__n_lines = 0 or __n_removed < __n_lines").drop("__n_lines", "__n_removed", "__n_near")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_session(spark)
    # a row without a doc_id goes by its text, after all ids below 2**62
    d = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))))
    groups = near_duplicates(d.select(F.col("__id").alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    out = d.join(first, "__id", "left_semi")
    if not d.groupBy("__id").count().where("count > 1").limit(1).isEmpty():
        rank = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("text")))
        out = out.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_session(spark)
    key = F.xxhash64("doc_id", "text")  # tells rows without a doc_id apart
    mixed, _ = mix_sources(docs.select(key.alias("doc_id"), "text", "source"))
    times = mixed.groupBy(F.col("doc_id").alias("__key")).agg(F.max("repeats").alias("__times")).where("__times > 0")
    out = docs.withColumn("__key", key).join(times, "__key")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean_session(spark)
    return encode_documents(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scratch() as staged:
            docs = stage(step(spark, docs, sf_dir), name)
            staged.remove(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
