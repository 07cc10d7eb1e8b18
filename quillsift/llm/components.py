"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillsift.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v.

    Large-star: each node ties its larger neighbours to the smallest of its neighbours and itself.
    Small-star: it ties itself and its smaller neighbours to the smallest of them.
    The smallest neighbour comes from an aggregate with map-side combine, and is joined back edge by edge: a node with
    a third of all edges is split like any other skewed key.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        made = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        made = edges.join(low, "u").select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return made.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) of all nodes with an edge; root is the smallest node of the component.

    ``edges`` has two columns of one orderable type, in any direction. Nulls and self-loops are dropped, repeated edges
    count once, an empty table gives an empty one. Each round is written to the shared folder, which cuts the
    lineage; the rounds end when every node is tied to its root directly, after a number that grows with the
    logarithm of the component's size.
    """
    a, b = edges.columns
    proper = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        # A forest of stars: no node hangs below another node that hangs, nor has two parents.
        nested = now.select("u").intersect(now.select("v")).limit(1).count()
        double = 0 if nested else now.groupBy("u").count().filter("count > 1").limit(1).count()
        if not nested and not double:
            break
        now = materialise(_star(_star(now, True), False))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
