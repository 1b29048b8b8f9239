"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontam, hosts, jaccard_join, licences, packing, passages, pii, rules, token_store
from .storage import materialize, new_path

#: Rules of the URL filter query: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.shingle_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return cotrain.score(table(spark, sf_dir, "documents"), labels)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"), least=51)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.digest(token_store.read_tokens(spark, path))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = rules.measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text")
    measured = materialize(measured, "measured")
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return rules.verdict(measured, rules.certify(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the pages whose url ends in the number of a labelled document; low quality is bad."""
    path = hosts.parse(F.col("url"))[1]
    named = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(path, r"^/[^/]*/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    return named.join(labels, "doc_id").select("page_id", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_decontamination": op2_decontamination,
        "op3_packing": op3_packing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_licences": op5_licences,
        "op6_passages": op6_passages,
        "op7_token_store": op7_token_store,
        "op8_pii": op8_pii,
        "op9_quality_rules": op9_quality_rules,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_licences": licences.oracle(), "op9_quality_rules": rules.oracle(), "op10_url_filter": hosts.oracle(URL_RULES)}
