"""Connected components over an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_apart, materialise


def _edge_set(pairs: DataFrame) -> DataFrame:
    """Undirected edges once each, smaller end first, without loops."""
    return (
        pairs.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer jumping: point each node of the forest ``(node, parent)`` at its root."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialise(join_apart(parents, above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.coalesce(F.col("grand") != F.col("parent"), F.lit(False)).alias("moved")), "jump")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(pairs: DataFrame) -> DataFrame:
    """``(u long, v long)`` pairs -> ``(node, root)``, root being the component's smallest node.

    Every round hooks each node to its smallest neighbour, flattens the forest
    and contracts the edges to the trees' roots, so the node count at least
    halves per round. A hub is one row after the partial ``min``, and a skewed
    relabelling join is one that adaptive execution can split. No pairs give no
    rows; loops and null ends are ignored.
    """
    edges = materialise(_edge_set(pairs), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u")).toDF("node", "other")
        hooked = both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
        forest = _flatten(materialise(hooked, "hooked"))
        levels.append(forest)
        left = forest.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = forest.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        edges = materialise(_edge_set(join_apart(join_apart(edges, left, "u"), right, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "edges")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[-1].select("node", F.col("parent").alias("root"))
    for forest in reversed(levels[:-1]):
        up = found.select(F.col("node").alias("parent"), "root")
        found = join_apart(forest, up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return materialise(found, "components")
