"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import discard, materialised


def _least(rows: DataFrame, smallest) -> DataFrame:
    """(u, m) of ``rows(u, v)``, written to the shared folder.

    A hub can be the ``u`` of very many rows. Tasks add their rows up before the shuffle, so finding m brings
    few of them together; and as a table of its own, m is joined to rows that come straight from a shuffle, which
    lets Spark split a hub's rows over several tasks.
    """
    return materialised(rows.groupBy("u").agg(smallest.alias("m")), "least")


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or itself). Beside the links, the table that they are read from."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, F.least(F.min("v"), F.col("u")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, F.min("v"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(u, v)`` but the roots: the smallest node that it reaches.

    Self-links and links that repeat change nothing. Each round is written to the shared folder, and only
    two numbers come to the driver; rounds end when the links stand still as stars.
    """
    links = materialised(links.select("u", "v").where("u <> v").distinct(), "links")
    mark = None
    while True:
        large, least = _large_star(links)
        stars = materialised(large, "links")
        discard(links, least)
        small, least = _small_star(stars)
        links = materialised(small, "links")
        discard(stars, least)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
