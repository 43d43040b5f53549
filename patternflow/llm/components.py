"""Connected components of a table of links, in rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternflow.llm.common import staged


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node with a link; ``label`` is the component's smallest node.

    Each round hangs all neighbours of a node on the smallest of them, so chains halve; the
    minima are taken before any exchange, which keeps hubs cheap. Every round is
    written to the shared scratch folder. Links to oneself count for nothing.
    """
    pair = F.array_sort(F.array(a, b))
    edges = links.select(F.get(pair, 0).alias("lo"), F.get(pair, 1).alias("hi")).filter("lo < hi").distinct()
    edges = staged(edges, "links")
    before = None
    while (state := _state(edges)) != before:
        before = state
        edges = staged(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the smallest of the node and its neighbours."""
    ways = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("lo"))
    larger = edges.select(F.col("lo").alias("u"), F.col("hi"))
    return larger.join(least, "u").select("lo", "hi").filter("lo < hi").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, linked to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    smaller = edges.join(least, "hi").select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
    own = least.select(F.col("least").alias("lo"), "hi")
    return smaller.unionByName(own).filter("lo < hi").distinct()
