"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node in edges (a, b); the label is the smallest node that can be reached.

    Each round every node takes the smallest label of itself, of its neighbours whose label has changed, and of the node that is its label, so labels travel distances that double. Both are looked up in one join, and
    minima are partial aggregates; labels are written after every round, and whether any has changed is counted on the way.
    """
    spark = edges.sparkSession
    both = C.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    path = C.scratch(spark)
    labels = C.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label", (F.col("label") != F.col("a")).alias("moved")), path)
    asked = both.select(F.col("a").alias("to"), F.col("b").alias("at"), F.lit(True).alias("edge"))
    while True:
        asks = asked.unionByName(labels.filter("label <> node").select(F.col("node").alias("to"), F.col("label").alias("at"), F.lit(False).alias("edge")))
        told = asks.join(labels, F.col("at") == F.col("node")).filter("moved or not edge").select("to", "label", F.lit(None).cast("long").alias("own"))
        every = told.unionByName(labels.select(F.col("node").alias("to"), "label", F.col("label").alias("own")))
        step = every.groupBy(F.col("to").alias("node")).agg(F.min("label").alias("label"), F.max("own").alias("own")).select("node", "label", (F.col("label") < F.col("own")).alias("moved"))
        seen, new_path = Observation(), C.scratch(spark)
        step = C.written(step.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")), new_path)
        C.drop_written(spark, path)
        labels, path = step, new_path
        if not seen.get["moved"]:
            return labels.select("node", "label")
