"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _ends(one, other):
    """Two rows a, b from each row, in one scan, where a union of the table with itself takes two."""
    return F.inline(F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in (one, other))))


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs below one node alone, and that below none: a round would change nothing."""
    ends = edges.select(_ends((F.col("a"), F.lit(1)), (F.col("b"), F.lit(0))))
    nodes = ends.groupBy("a").agg(F.sum("b").alias("above"), F.count("*").alias("n"))
    return not nodes.agg(F.count_if(F.expr("above > 0 and n > 1"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> id, component: the smallest id reachable, for each id that has a link to another.

    Each round hangs every node's larger neighbours below its smallest one (large star), then its smaller ones
    (small star), until only stars are left; rounds grow as the logarithm of the longest path. Minima are taken by
    partial aggregation, so a node with very many links is no single task's work. Each round is kept as a table.
    Neither star makes more rows than two for each edge, so only a round's result is made distinct.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.select(_ends((F.col("a"), F.col("b")), (F.col("b"), F.col("a"))))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "b")
        large = edges.join(low, "b").select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(_ends((F.col("a"), F.col("m")), (F.col("b"), F.col("m")))).where("a <> b").distinct()
        new = saved(small, "edges")
        forget(edges)
        edges = new
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
