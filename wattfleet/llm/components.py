"""Connected components of a table of links, by distributed union-find.

Alternates the large-star and the small-star operation until the links no longer
change. Neither needs all links of a node in one task: the smallest neighbour is a
partial aggregate and the links are joined to it, so a hub is split as any skewed
join. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select("a", F.col("m").alias("b")))


def _signature(links: DataFrame) -> tuple:
    # Sums of halves cannot overflow and differ whenever a link moves.
    h = F.xxhash64("a", "b")
    row = links.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for every node of a link; the component is its smallest node.

    Links from a node to itself, repeated links and links with a null end count for
    nothing; a node that has no other link has no row. An empty table gives no rows.
    """
    now = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = stored(_small_star(now).distinct(), "links")
    before, after = None, _signature(now)
    while after != before:
        now = stored(_small_star(_large_star(now)).distinct(), "links")
        before, after = after, _signature(now)
    # Links are stars now: each node points at the smallest node of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
