"""Connected components of a distributed edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintleaf.llm.common import written


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v): label is the least node of its component.

    In each round every label moves to the first of itself and its neighbours in the order of the round, and the edges
    are relabelled; edges within a label go. Two rounds in the order of ids settle stars and cliques; from then on the
    order is a new hash every two rounds, under which also long chains lose a constant share of their labels in a
    round. The tables of a round are written to the shared folder; nothing but row counts reaches the driver.
    """
    open_edges = written(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = open_edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while open_edges.limit(1).count():
        both = open_edges.unionByName(open_edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct((F.col(c) if turn < 2 else F.xxhash64(F.col(c), F.lit(turn // 2))).alias("o"), F.col(c).alias("x"))  # noqa: E731, B023
        step = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("label"), F.least(order("u"), "m")["x"].alias("to"))
        step = written(step, "labels")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        u, v = (step.select(F.col("label").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v"))
        moved = open_edges.join(u, "u").join(v, "v").select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
        open_edges = written(moved.filter("u != v").distinct(), "edges")
        turn += 1
    labels = written(labels, "components")
    if turn > 2:
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = written(labels.join(least, "label").select("node", F.col("least").alias("label")), "components")
    return labels
