"""Connected components by contraction, without gathering any group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every end of ``edges`` (a, b); root is one key of the component.

    Each round points every key at its smallest neighbour if that is smaller,
    follows the pointers, and replaces the ends of the edges by what they point
    at. Every key with an edge left merges with another, so the number of keys
    at least halves; rounds end when no edge is left. Each round is written, so
    no lineage grows. An empty frame gives an empty frame.
    """
    edges = stage_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(
            edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        point = stage_table(both.groupBy("v").agg(F.least("v", F.min("u")).alias("p")), "pointers")
        for _ in range(2):
            onward = point.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            point = point.join(onward, "p").select("v", F.col("pp").alias("p"))
        point = stage_table(point, "pointers")
        to = point.select(F.col("v").alias("root"), F.col("p").alias("_to"))
        if labels is None:
            labels = point.select(F.col("v").alias("key"), F.col("p").alias("root"))
        else:
            labels = stage_table(labels.join(to, "root", "left")
                                 .select("key", F.coalesce("_to", "root").alias("root")), "labels")
        at_a = point.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        at_b = point.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = stage_table(edges.join(at_a, "a").join(at_b, "b")
                            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
                            .where("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
    return labels
