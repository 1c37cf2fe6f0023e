"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of ``edges`` (a, b); comp is some node of the component, the same for all of it.

    Each round every node hooks onto its least neighbour and the graph is contracted along the hooks. With ids that
    are hashes the rounds grow with the logarithm of the nodes. A node's neighbours are only ever reduced to their
    minimum, with partial minima on the map side, so a node of very many links is no burden. No edges: no rows.
    """
    e = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    found = None
    while not e.isEmpty():
        hook = materialize(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "cc-hooks")
        if found is None:
            found = hook.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            found = materialize(found.join(hook, found.comp == hook.a, "left").select("node", F.coalesce("p", "comp").alias("comp")), "cc-found")
        left = hook.select(F.col("a").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = materialize(e.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "cc-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0) if found is None else found
