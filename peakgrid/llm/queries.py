"""Registered queries of the corpus operators: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, embeddings, licences, lm, merkle, packing, rules, sharding, simhash, urls, warc
from .common import store, table

#: Name of the vocabulary file among the public tokenizers.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         F.col("component").alias("component_id"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    views = store(classifier.vectors(table(spark, folder, "documents")), "vectors")
    model = classifier.train(views, views, table(spark, folder, "labels"))
    return classifier.score(views, model).withColumn("kept", F.col("score") >= 0.5)


@query
def op2_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), tokenizer_path()
    both = bpe.round_trip(docs, path, bpe.build_lexicon(docs, path))
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, folder)


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op7_sharding"] = sharding.SQL


@query
def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merkle.audit(docs, merkle.tampered(docs))


ORACLE["op11_merkle_manifest"] = merkle.check_sql()


@query
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents")).drop("notices")


@query
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment.score(alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
