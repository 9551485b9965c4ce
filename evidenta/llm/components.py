"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

No neighbourhood is ever collected: each round is a minimum per node (with a map-side combine) and a join that
broadcasts the counted minima of hubs, so a hub with a third of all links is spread over all tasks.  Each round is
written to the shared folder, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, heavy_rows, join_counted, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, links: int, hub: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours.

    ``hub``: the most links that one node has as the smaller end; where that is a thousandth of all, hubs are spread.
    """
    sides = _both_ways(edges)
    least = sides.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    larger = sides.where("b > a")
    if hub > heavy_rows(links):
        joined = join_counted(larger, least, ["a"], "n", links)
    else:
        joined = larger.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.least(F.col("a"), F.col("least")).alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these.

    After a large star a node has at most as many smaller neighbours as it had neighbours, so nothing is spread here.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """(links, a digest of them, the most links of one smaller end)."""
    by_end = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return tuple(by_end.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.max("n")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is its smallest node."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(now)
    while before[0]:
        large = _large_star(now, before[0], before[2]).where("a <> b").distinct()
        last, now = now, stored(_small_star(large).where("a <> b").distinct(), "links")
        dropped(last)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
