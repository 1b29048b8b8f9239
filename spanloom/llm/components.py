"""Connected components of an edge table, by rounds of hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, counter: dict | None = None) -> DataFrame:
    """node, component (smallest node reachable) of ``edges`` (a, b: long); only nodes with an edge.

    In each round every root hooks to its smallest neighbour if that is smaller, pointers jump (doubling) until all point to
    roots, and edges are contracted. A root that can't hook is the smallest of its neighbours; either another hooks to it, or
    all hook below it, and it hooks in the next round: two rounds at least halve the roots that have edges, and a tree of
    depth d takes log2(d) + 1 jumps. Nothing is gathered: all tables stay distributed and are written to the shared folder;
    those that are done with are deleted, the result with ``scratch``. No edges give no rows. ``counter`` counts rounds and jumps.
    """
    spark, count = edges.sparkSession, counter if counter is not None else {}
    labels = scratch or Scratch(spark)
    count.update(rounds=0, jumps=0)
    with Scratch(spark) as s:
        left = s.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        label = None
        while left.head(1):
            count["rounds"] += 1
            both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            jump = s.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).withColumn("moved", F.lit(True)), "hook")
            while jump.where("moved").head(1):
                count["jumps"] += 1
                up2 = jump.select(F.col("a").alias("up"), F.col("up").alias("up2"))
                last, jump = jump, s.table(jump.join(up2, "up").select("a", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved")), "jump")
                s.drop(last)
            jump = jump.drop("moved")
            if label is None:
                label = labels.table(jump.select(F.col("a").alias("node"), F.col("up").alias("component")), "labels")
            else:
                moved = label.join(jump.select(F.col("a").alias("component"), "up"), "component", "left")
                last, label = label, labels.table(moved.select("node", F.coalesce("up", "component").alias("component")), "labels")
                labels.drop(last)
            to_a = jump.select("a", F.col("up").alias("ra"))
            to_b = jump.select(F.col("a").alias("b"), F.col("up").alias("rb"))
            moved = left.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            last, left = left, s.table(moved.distinct(), "edges")
            s.drop(last)
    return spark.createDataFrame([], "node long, component long") if label is None else label
