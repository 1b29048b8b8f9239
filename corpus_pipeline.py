"""A training-corpus pipeline over ``documents``: quality rules, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Near duplicates and benchmark leaks are judged by
text, so rows that share an id or have none are told apart; of equal rows of a group one stays. All but the last stage return the
columns of ``docs``, whatever else they hold. Null and empty texts fail the quality rules; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, jaccard_join, packing, pii, rules
from spanloom.llm.sieve import bitmap, literal, may_hold
from spanloom.llm.storage import materialize, new_path


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _decided(docs: DataFrame, decisions: DataFrame, by: Column) -> DataFrame:
    """``docs`` by ``decisions`` (key, once): rows whose key ``by`` isn't there stay; of a key's rows one stays if ``once``, else none.

    Only rows that a fixed-size bitmap can't clear are shuffled.
    """
    key, once = _free(docs, "key"), _free(docs, "once")
    decisions = materialize(decisions.toDF(key, once), "decisions")
    held = may_hold(literal(bitmap(decisions.select(key))), by)
    maybe = docs.where(held).withColumn(key, by).join(decisions, key, "left")
    stay = maybe.where(F.col(once).isNull()).unionByName(maybe.where(F.col(once)).dropDuplicates([key]))
    return docs.where(~held).unionByName(stay.drop(key, once))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    measured = materialize(rules.measure(docs.select("doc_id", "lang", "text")).drop("text"), "measured")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"))
    cutoffs = materialize(rules.certify(measured, labels), "cutoffs")
    return rules.verdict(rules.measure(docs.select("lang", "text", F.struct("*").alias("_row"))), cutoffs).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, Jaccard 0.8): the smallest id, without ids the smallest text hash."""
    linked = jaccard_join.shingle_components(docs, k=5, num=8, den=10).where("n > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = linked.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    best = rows.groupBy("component").agg(F.min(rank).alias("best"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    judged = rows.join(best, "component").select("doc_id", "text_hash", "rows", (rank == F.col("best")).alias("first"))
    gone = judged.where(~F.col("first") | (F.col("rows") > 1)).select(F.xxhash64("doc_id", "text_hash"), "first")
    return _decided(docs, gone, F.xxhash64(F.col("doc_id").cast("long"), jaccard_join.text_hash()))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; equal texts are judged alike."""
    texts = jaccard_join.keyed(docs).select(F.col("text_hash").alias("doc_id"), "text")
    found = decontam.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _decided(docs, found.select("doc_id", F.lit(False)).distinct(), jaccard_join.text_hash())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("packing", pack),
]
#: Model fitting, components and packing are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
