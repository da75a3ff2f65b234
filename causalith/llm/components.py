"""Connected components of an edge table by repeated contraction under random orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for all ends of ``edges`` (``a``, ``b``: long).

    Each round every node takes the first of its neighbours and itself, in an order drawn by hash, and the edges are carried
    over to the nodes taken, until no edge is left. On a path about half of the nodes are taken, on a star few, so the
    number of rounds is about the logarithm of the nodes, whatever the shape; an order serves two rounds, which end a star.
    Sums are made before each shuffle, and nothing is gathered by node, so a node may have any number of edges. Loops keep
    their node; edges with a null end are left out.
    """
    left = materialize(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "edges")
    labels, turn = None, 0
    while True:
        rank = lambda c, turn=turn: F.xxhash64(F.lit(turn // 2), c)
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = both.groupBy("node").agg(F.min_by("other", rank("other")).alias("other"))
        least = materialize(first.select("node", F.when(rank("other") < rank("node"), F.col("other")).otherwise(F.col("node")).alias("label")), "least")
        if labels is None:
            labels = least
        else:
            step = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialize(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        at = lambda end, least=least: least.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        carried = left.filter("a <> b").join(at("a"), "a").join(at("b"), "b").filter("la <> lb")
        left = materialize(carried.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            names = labels.groupBy("label").agg(F.min("node").alias("least"))
            return materialize(labels.join(names, "label").select("node", F.col("least").alias("label")), "labels")
        turn += 1
