"""Connected components by contraction: every node joins its smallest neighbour, then edges are moved to the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.scratch import Stored, store


def _roots(parents: Stored) -> Stored:
    """Follows parents (node, root) to their ends by doubling; parents are smaller than their children."""
    while True:
        above = parents.df.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        jumped = store(
            parents.df.join(above, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")),
            "roots",
        )
        parents.drop()
        if jumped.df.where("moved").isEmpty():
            return Stored(jumped.df.drop("moved"), jumped.path)
        parents = Stored(jumped.df.drop("moved"), jumped.path)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node of its component.

    ``links`` has a and b; direction, repetition, self-links and nulls do not matter. Each round at least halves the
    nodes that are left, and a hub is a key with partial aggregation or one side of a join that AQE can split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = store(both.where("a <> b").distinct(), "edges")
    known: Stored | None = None
    while not edges.df.isEmpty():
        smallest = edges.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        found = _roots(store(_with_ends(smallest), "parents"))
        root_of = lambda name: found.df.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        moved = edges.df.join(root_of("a"), "a").join(root_of("b"), "b").where("_a <> _b")
        fewer = store(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        edges.drop()
        edges = fewer
        if known is None:
            known = found
        else:
            up = found.df.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            merged = known.df.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
            merged = store(merged, "roots")
            known.drop()
            found.drop()
            known = merged
    edges.drop()
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    return known.df


def _with_ends(smallest: DataFrame) -> DataFrame:
    """A node smaller than all its neighbours is its own root."""
    return smallest.select("node", F.least("node", "root").alias("root"))
