"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: hangs neighbours of each node on its least neighbour.

    The least neighbours are a table of their own: the join then has two plain exchanges, and Spark can
    split the edges of a node that many hang on."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sym = edges.unionByName(turned) if large else edges
    least = cut(sym.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    joined = sym.join(least.hint("merge"), "a")  # never by way of the driver
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                             F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
    return out.where("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (node, root): the least node of the component, for every node that has
    an edge and isn't the root itself. Alternating large and small stars; each round's edges are
    written to the shared folder. Raises if max_rounds don't suffice."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        with scratch(edges.sparkSession) as kept:
            large = cut(_star(edges, True), "edges")
            edges = cut(_star(large, False), "edges")
            kept.append(edges)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
