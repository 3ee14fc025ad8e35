"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it back as the next one's documents. All but the last return the columns of `documents`; the last one adds size,
source_size, target and taken (words that the mix takes; a document the mix leaves out is gone).

Whole documents go only for what a stage is there for: no letters or no language near enough (language ID), no line left
(line dedup), a copy of a document that stays (near dedup), a benchmark passage (decontamination).

SQL cannot express string-kernel regression or HyperMinHash components, so ORACLE_SQL is None; tests compare with
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize, small, table
from corpusloom.llm.op01_line_dedup import dedup_lines
from corpusloom.llm.op04_mixing import mix
from corpusloom.llm.op06_language_id import identify
from corpusloom.llm.op08_decontaminate import decontaminate
from corpusloom.llm.op10_near_dedup import near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    found = identify(docs).where("lang_near")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dedup_lines(docs).where((F.col("n_lines") > F.col("n_removed")) | (F.col("n_lines") == 0))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, hashed = fresh(docs.columns, "_id", "_hash")
    found = materialize(near_duplicates(docs.select("doc_id", "text")), "near")

    def keys(rows: DataFrame) -> DataFrame:
        return small(materialize(rows.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).distinct(), "keys"))

    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed))
    kept = docs.join(keys(found.where(~F.col("kept"))), same, "left_anti")
    repeats = found.where("n_shingles > 0 and kept").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeats.isEmpty():
        return kept.select(*docs.columns)
    repeats = keys(repeats)  # one of the rows that repeat a doc_id and text stays
    once = kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeats, same, "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("taken > 0")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
