"""Problem 5: pairwise matches consolidated into groups, by alternating large-star and small-star rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.session import cut_and_measure, cut_lineage, hot_split_join


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges (big, small) with big > small."""
    e = edges.select(F.greatest("big", "small").alias("big"), F.least("big", "small").alias("small"))
    return e.filter("big > small").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(big, least): of each node the least neighbour below it."""
    return edges.groupBy("big").agg(F.min("small").alias("least"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node is linked to the least neighbour of that node instead (to the node where it has none below)."""
    uses = edges.groupBy(F.col("small").alias("node")).agg(F.count("*").alias("uses"))
    least = _least(edges).withColumnRenamed("big", "node")
    moved = hot_split_join(edges.withColumnRenamed("small", "node"), least, "node", "uses", total, F.col("big"), "left", counts=uses)
    return moved.select("big", F.coalesce("least", "node").alias("small")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its neighbours below it are all linked to the least of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"), F.count("*").alias("uses"))
    links = hot_split_join(edges, least, "big", "uses", total, F.col("small"))
    below = links.filter("small > least").select(F.col("small").alias("big"), F.col("least").alias("small"))
    return below.unionByName(least.select("big", F.col("least").alias("small"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """An edge set, written, and its (rows, sum of row hashes), taken on the way."""
    out, seen = cut_and_measure(edges, n=F.count(F.lit(1)), h=F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")))
    return out, (seen["n"] or 0, int(seen["h"] or 0))


def components(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(node, component): every node of `pairs` that is linked to another one, with the least node linked to it directly or indirectly.

    Large-star and small-star alternate until the edge set no longer changes; then each node hangs on its component's
    least node. Rounds grow with the logarithm of the longest chain. Each round is written to the shared checkpoint
    folder; one count and one hash sum, taken while it is written, come to the driver. Nodes that many edges point to
    (the centres of the stars) are few; their rows are spread over many tasks, all other keys have few rows.

    Null ends and pairs of a node with itself link nothing; repeated and reversed pairs count once; extra columns
    don't matter; an empty table gives no rows.
    """
    edges, seen = _written(_oriented(pairs.select(F.col(left).alias("big"), F.col(right).alias("small")).filter("big IS NOT NULL AND small IS NOT NULL")))
    for _ in range(max_rounds):
        large = cut_lineage(_large_star(edges, seen[0]))
        edges, now = _written(_small_star(large, seen[0]))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every edge now runs from a member to its component's least node.
    members = edges.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return members.unionByName(edges.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())


def group_links(df: DataFrame, node: str, group) -> DataFrame:
    """(big, small): each record of a group of two or more linked to the group's least record; never all its pairs.

    The groups' least records are found by partial aggregation, and the rows of large groups are spread over many
    tasks, so a group of any size can be linked.
    """
    rows = df.select(F.col(node).alias("big"), group.alias("grp")).filter("big IS NOT NULL AND grp IS NOT NULL")
    least = rows.groupBy("grp").agg(F.min("big").alias("small"), F.count("*").alias("n"))
    total = df.count()
    return hot_split_join(rows, least, "grp", "n", total, F.col("big")).filter("big > small").select("big", "small")


def linked_groups(links: list[DataFrame]) -> DataFrame:
    """components() over several sets of (big, small) links."""
    return components(reduce(DataFrame.unionByName, links), "big", "small")
