"""Connected components of a large graph by contraction, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of (a, b): label is the smallest id of its component.

    In each round every vertex that still has neighbours takes the smallest of them as its
    parent.  Such choices meet in pairs alone (the smallest vertex of a cycle and its parent
    choose each other), and of a pair the smaller becomes a root.  Pointers are doubled until
    all lead to roots, and edges between roots are the next round's graph.  Each root has taken
    up another vertex at least, so a round halves the vertices that have neighbours, in whatever
    order their ids are, and a round doubles its pointers at most log2 of its longest path
    times: no limit of rounds is needed.  Tables between rounds are written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct(), "labels")
    both = stored(both.where("a <> b").distinct(), "edges")
    while not both.isEmpty():
        chosen = stored(both.groupBy("a").agg(F.min("b").alias("p")), "chosen")
        back = chosen.select(F.col("a").alias("p"), F.col("p").alias("up"))
        parents = stored(chosen.join(back, "p").select("a", F.when((F.col("up") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p")), "parents")
        while True:
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("up"))
            parents = stored(parents.join(up, "p").select("a", F.col("p").alias("old"), F.col("up").alias("p")), "parents")
            if parents.where("p <> old").isEmpty():
                break
        parents = parents.select("a", "p")
        labels = stored(labels.join(parents.select(F.col("a").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")), "labels")
        ends = both.join(parents, "a").select("b", F.col("p").alias("pa")).join(parents.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        both = stored(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return labels.join(labels.groupBy("root").agg(F.min("id").alias("label")), "root").select("id", "label")
