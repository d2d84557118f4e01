"""The corpus pipeline: filter, classify, remove near-duplicates, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Null ids pass every filter that cannot tell; null texts fail the quality rules; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakgrid.llm import classifier, packing, rules, simhash
from peakgrid.llm.common import store, table, text_or_empty
from peakgrid.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the robust outlier test reject."""
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below one half; fitted on the labelled documents of the whole corpus, co-trained on ``docs``."""
    model = classifier.train(classifier.vectors(table(spark, sf_dir, "documents")), store(classifier.vectors(docs), "vectors"), table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike by 0.8 or more in five-word shingles, the row with the smallest id stays, one row for each group.

    Rows are told apart by a number of their own, so repeated and null ids are judged by their texts; a null id stays only if no other of its group has an id.
    """
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_rows(rows.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same", "row")).alias("least")).select(F.col("least.row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("simhash_dedup", simhash_dedup), ("best_fit_packing", best_fit_packing)]

#: Robust estimates, co-training and sign projections have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
