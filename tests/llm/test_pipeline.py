"""The pipeline's stages on small documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.util import docs


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    base = say(120)
    item = say(30)
    rows = [(i, say(100)) for i in range(40)]
    rows += [(100, base), (101, base), (102, base + " tail"), (103, "short"), (104, f"{say(60)} {item} {say(20)}"), (105, f"{say(80)} x@y.example.com"), (None, say(70)), (106, None)]
    df = docs(spark, rows)
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at = df
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == df.columns
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    every = {d for d, _ in rows}
    assert kept == [every - {103, 106}, every - {103, 106, 101, 102}, every - {103, 106, 101, 102, 104}, every - {103, 106, 101, 102, 104}]
    assert at.where("doc_id = 105").head().text.endswith("[EMAIL]")
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept[-1]
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert whole.where("n <> t").count() == 0


def test_rows_are_told_apart(spark, tmp_path):
    """Repeated ids, rows without one, equal rows, a long text and columns named like those that stages use inside."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    one, two, item = say(100), say(100), say(30)
    rows = [(1, one), (1, one), (1, say(90)), (None, one + " end"), (None, two), (None, two), (2, f"{say(60)} {item}"), (2, say(80)), (3, say(60_000)), (4, None)]
    df = docs(spark, rows).selectExpr("*", "1 as _id", "2 as key", "3 as once", "4 as _key", "5 as n_words", "6 as kept", "7 as stratum", "8 as cutoffs")
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at = df
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, sf)
        assert at.columns == df.columns, name
    got = sorted(((r.doc_id, r.text) for r in at.collect()), key=str)
    assert got == sorted([(1, one), rows[2], (None, two), rows[7], rows[8]], key=str)
    assert at.where("_id = 1 and key = 2 and once = 3 and _key = 4 and n_words = 5 and kept = 6 and stratum = 7 and cutoffs = 8").count() == 5
    empty = df.where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0, name
