"""Trees and visibility over edges parent -> child that hold for a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved


def edges_at(edges: DataFrame, at: Column) -> DataFrame:
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("parent", "child")


def subtree(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: all nodes below each root, itself at depth 0, by the shortest way; cycles end.

    Each round joins the last round's nodes to their children and drops what was reached before. Rounds are written to
    the shared folder, so that plans don't grow with the depth.
    """
    keep = lambda df: saved(df, "round")
    rounds = [keep(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())]
    while (max_depth is None or len(rounds) <= max_depth) and not rounds[-1].isEmpty():
        reached = rounds[-1].join(edges, rounds[-1]["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, rounds).select("root", "node")
        rounds.append(keep(reached.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(len(rounds)))))
    return reduce(DataFrame.unionByName, rounds)


def visible(edges: DataFrame, viewers: DataFrame, grants: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """viewer, node: oneself, nodes granted, and all below either; a grant of '*' shows `everyone` (a column node)."""
    own = viewers.select("viewer", F.col("viewer").alias("node"))
    start = own.unionByName(grants.where("node <> '*'").select("viewer", "node")).distinct()
    below = subtree(edges, start.select("node").distinct())
    out = start.join(below.withColumnRenamed("node", "under"), start["node"] == below["root"]).select("viewer", F.col("under").alias("node"))
    if everyone is not None:
        out = out.unionByName(grants.where("node = '*'").select("viewer").distinct().crossJoin(everyone.select("node")))
    return out.distinct()


def forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, node, depth of the trees among `nodes`: roots have a child among them and no parent among them."""
    among = edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").join(nodes.select(F.col("node").alias("child")), "child", "left_semi").select("parent", "child")
    roots = among.select(F.col("parent").alias("node")).distinct().join(among.select(F.col("child").alias("node")), "node", "left_anti")
    return subtree(among, roots)


def numbering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, start, size, least, greatest: the nodes of a forest numbered in preorder within their tree.

    All below a node are those of its root with numbers from start to start + size - 1; least and greatest are the smallest
    and largest of them. Nodes of `nodes` without edges are trees of their own. A node with two parents is an error, nodes that
    no root leads to (a cycle) have no number. A round for each level down, up and down again, each a written table.
    """
    edges = edges.select("parent", "child").where("parent <> child").distinct()
    if edges.groupBy("child").count().where("count > 1").limit(1).count():
        raise ValueError("a node has two parents: no forest")
    every = nodes.select("node").unionByName(edges.select(F.col("parent").alias("node"))).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    level = saved(every.join(edges.select(F.col("child").alias("node")), "node", "left_anti").select("node", F.lit(None).cast(every.schema["node"].dataType).alias("parent"), F.col("node").alias("root")), "level")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        level = saved(level.select(F.col("node").alias("parent"), "root").join(edges, "parent").select(F.col("child").alias("node"), "parent", "root"), "level")
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            below = sized[-1].groupBy("parent").agg(F.sum("size").alias("s"), F.min("least").alias("a"), F.max("greatest").alias("z")).withColumnRenamed("parent", "node")
            level = level.join(below, "node", "left").select("node", "parent", "root", (F.coalesce("s", F.lit(0)) + 1).alias("size"), F.least("node", "a").alias("least"), F.greatest("node", "z").alias("greatest"))
        else:
            level = level.select("node", "parent", "root", F.lit(1).cast("long").alias("size"), F.col("node").alias("least"), F.col("node").alias("greatest"))
        sized.append(saved(level, "sizes"))
    columns = ["node", "root", "start", "size", "least", "greatest"]
    out: list[DataFrame] = []
    older = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    for level in reversed(sized):
        if out:
            parents = out[-1].select(F.col("node").alias("parent"), F.col("start").alias("s"))
            level = level.withColumn("before", F.coalesce(F.sum("size").over(older), F.lit(0))).join(parents, "parent").withColumn("start", F.col("s") + 1 + F.col("before"))
        else:
            level = level.withColumn("start", F.lit(0).cast("long"))
        out.append(saved(level.select(*columns), "numbers"))
    return reduce(DataFrame.unionByName, out) if out else every.select("node", F.col("node").alias("root"), *[F.lit(0).cast("long").alias(c) for c in ("start", "size")], F.col("node").alias("least"), F.col("node").alias("greatest"))


def visible_ranges(numbers: DataFrame, viewers: DataFrame, grants: DataFrame) -> DataFrame:
    """viewer, root, start, size, least, greatest: what viewers see (as in visible) as ranges of numbering(), none within another; root null: everything.

    A viewer or grant without a number is left out. Rows grow with viewers and grants, whatever lies below them.
    """
    all_seen = grants.where("node = '*'").select("viewer").distinct()
    own = viewers.select("viewer", F.col("viewer").alias("node")).unionByName(grants.where("node <> '*'").select("viewer", "node")).distinct()
    ranges = own.join(all_seen, "viewer", "left_anti").join(numbers, "node").drop("node")
    earlier = Window.partitionBy("viewer", "root").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    top = ranges.withColumn("__until", F.max(F.col("start") + F.col("size")).over(earlier)).where("__until is null or __until <= start").drop("__until")
    return top.unionByName(all_seen.select("viewer", *[F.lit(None).cast(t).alias(c) for c, t in top.dtypes if c != "viewer"]))


def visible_counts(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """viewer, nodes, first_node, last_node of visible_ranges."""
    every = numbers.agg(F.count("*").alias("__n"), F.min("node").alias("__a"), F.max("node").alias("__z"))
    own = ranges.where("root is not null").groupBy("viewer").agg(F.sum("size").alias("nodes"), F.min("least").alias("first_node"), F.max("greatest").alias("last_node"))
    return own.unionByName(ranges.where("root is null").select("viewer").crossJoin(F.broadcast(every)).toDF("viewer", "nodes", "first_node", "last_node"))  # one row


def can_see(numbers: DataFrame, ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (viewer, node) with `seen`: whether the node's number lies in a range of the viewer. A node without a number is seen by none."""
    pairs = asked.select("viewer", "node").distinct().join(numbers.select("node", "root", F.col("start").alias("__at")), "node")
    own = ranges.where("root is not null").select("viewer", "root", "start", "size")
    inside = pairs.join(own, ["viewer", "root"]).where("__at >= start and __at < start + size").select("viewer", "node")
    everything = pairs.join(ranges.where("root is null").select("viewer"), "viewer", "left_semi").select("viewer", "node")
    seen = inside.unionByName(everything).distinct().withColumn("seen", F.lit(True))
    return asked.join(seen, ["viewer", "node"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
