"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_blocks, join_dealt


#: Links of one node that a task may have, and links in a partition.
HOT_LINKS, PART_LINKS = 1 << 16, 250_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link; the component is its least node.

    ``edges`` may hold repeats, loops, either direction and nulls (a link with a
    null end is none). Links stay distributed; each round is checkpointed, so a
    lost executor costs one round at most. Rounds grow with the logarithm of
    the longest chain of links. The links of a node that has very many, as the middle of a
    star, are dealt over several tasks.
    """
    links = checkpointed(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct()
    )
    state = _state(links)
    while state[0]:
        # few links are few partitions, whatever the session's number of these
        parts = -(-state[0] // PART_LINKS)
        links = checkpointed(_small_star(_large_star(links.coalesce(parts), state[0], parts), state[0], parts).coalesce(parts))
        if (now := _state(links)) == state:
            break
        state = now
    # every node now points straight at the least node of its component
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame, total: int, parts: int) -> DataFrame:
    """Larger neighbours of every node go to the least node of its neighbourhood."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _with_least(larger, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct()


def _small_star(links: DataFrame, total: int, parts: int) -> DataFrame:
    """Smaller neighbours of every node, and the node, go to the least of them."""
    if total > HOT_LINKS:
        links = checkpointed(links)  # it is counted first
    links = links.coalesce(parts)
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(links, least, total).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct()


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links with ``m`` of their ``a``; those of a node with over ``HOT_LINKS`` are dealt."""
    if total <= HOT_LINKS:
        return links.join(least, "a")
    hot = hot_blocks(links.groupBy("a").agg(F.count("*").alias("n")), "a", HOT_LINKS, total)
    return join_dealt(links, least, "a", hot, ["b"])
