"""Connected components of a graph too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def components(edges: DataFrame, work: Work, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); isolated nodes do not appear.

    Each round maps every node to the least of its neighbours and itself and
    contracts the graph by that map. Node names are hashes, so the least
    neighbour is a random one and a constant part of the nodes goes each round.
    The minimum is taken with map-side combining, so a hub costs no more than
    others, and every round is cut by a table.
    """
    maps: list[DataFrame] = []
    given = edges = edges.where("a <> b")
    for step in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), f"least{step}")
        maps.append(least)
        left = least.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = least.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fewer = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, edges = edges, work.save(fewer, f"edges{step}")
        if before is not given:
            work.drop(before)
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("__last"))
        found = earlier.join(later, "root", "left").select("node", F.coalesce("__last", "root").alias("root"))
    found = work.save(found, "components")
    work.drop(edges, *maps)
    return found
