"""Connected components over an edge table: min labels and pointer jumping, no collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any order, repeats allowed -> (node, comp), comp the smallest node.

    Each round takes the least label among neighbours, jumps label of label, and rewrites
    the edges by label, so stars and chains both contract in logarithmic rounds. Nodes
    without an edge have no row; an empty table gives an empty table.
    """
    both = edges.filter("a <> b").select("a", "b")
    live = scratch.cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.cut(live.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")))
    while live.limit(1).count():
        low = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        low = scratch.cut(low.select("node", F.least("node", "m").alias("to")))
        # jump once: the label's own label
        far = low.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = scratch.cut(low.join(far, "to", "left").select("node", F.coalesce("to2", "to").alias("to")))
        by_a = step.select(F.col("node").alias("a"), F.col("to").alias("la"))
        by_b = step.select(F.col("node").alias("b"), F.col("to").alias("lb"))
        nxt = live.join(by_a, "a").join(by_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        nxt = scratch.cut(nxt.filter("a <> b").distinct())
        moved = step.select(F.col("node").alias("comp"), F.col("to").alias("new"))
        new = scratch.cut(labels.join(moved, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))
        scratch.drop(live, labels, low, step)
        live, labels = nxt, new
    # a component's last label need not be its smallest node after jumps between rounds
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    done = scratch.cut(labels.join(least, "comp").select("node", F.col("least").alias("comp")))
    scratch.drop(live, labels)
    return done
