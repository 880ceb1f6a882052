"""Connected components of a graph of links: every node hangs on a smaller one of its component, and in rounds
of joins takes over the grandparents of its neighbours and of its children (as FastSV does)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _grand(parents: DataFrame, few: bool) -> DataFrame:
    """(node, parent, grand) of parents (node, parent)."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(common.held(above, few), "parent").select("node", "parent", "grand")


def _ends(edges: DataFrame, parents: DataFrame, few: bool) -> DataFrame:
    """(u, v) of the edges, with the columns of parents (node and more) for u and, followed by a 2, for v."""
    rest = [c for c in parents.columns if c != "node"]
    u, v = parents.withColumnRenamed("node", "u"), parents.select(F.col("node").alias("v"), *[F.col(c).alias(f"{c}2") for c in rest])
    return edges.join(common.held(u, few), "u").join(common.held(v, few), "v")


def _star(edges: DataFrame, parents: DataFrame, few: bool) -> DataFrame:
    """Hang each node, and its parent, on the least grandparent of it and its neighbours.

    Neighbourhoods are only ever reduced to a minimum and joined, never gathered."""
    grand = common.materialize(_grand(parents, few))
    ends = _ends(edges, grand, few)
    offers = [F.struct(F.col(to).alias("node"), F.col(at).alias("parent")) for to, at in (("u", "grand2"), ("parent", "grand2"), ("v", "grand"), ("parent2", "grand"))]
    offers = ends.select(F.explode(F.array(*offers)).alias("x")).select("x.node", "x.parent")
    return offers.unionByName(grand.select("node", F.col("grand").alias("parent"))).groupBy("node").agg(F.min("parent").alias("parent"))


def _settled(edges: DataFrame, parents: DataFrame, few: bool) -> bool:
    """Whether every node hangs on a root, and the ends of every edge on the same one."""
    deep = _grand(parents, few).filter("parent != grand").select("parent")
    return deep.unionByName(_ends(edges, parents, few).filter("parent != parent2").select("parent")).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the least node of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    edges = common.materialize(edges)
    few = common.few(edges)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parents = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent")))
    while not _settled(edges, parents, few):  # a table after each round keeps plans small: the driver holds and plans anew what is in them
        parents = common.materialize(_star(edges, parents, few))
    return parents.select("node", F.col("parent").alias("root"))
