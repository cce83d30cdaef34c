"""Connected components of a graph given by its links, by repeated contraction.

In each round every vertex points to the least of itself and its neighbours, pointers are doubled until none moves, links
are rewritten to what their ends point to, and loops and repeats go. A star of any size is gone after two rounds and a
chain of n in order after one round of log n doublings; and no step needs the links of one vertex together: minima are
combined before the shuffle. Each step is written to the checkpoint folder, so neither lineage nor the driver grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable of every vertex that has a link to another. Null ends are no links."""
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    labels = None
    while edges.limit(1).count():
        points = _roots(edges)
        if labels is None:
            labels = points.select("id", F.col("to").alias("component"))
        else:
            labels = cut(labels.join(points.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        moved = edges.join(points.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(moved.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) once links (a, b) are added: only what the new links touch is contracted again."""
    one = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    further = cut(components(ends))
    renamed = labels.join(further.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return renamed.unionByName(further.join(labels, "id", "left_anti").select("id", "component"))


def _roots(edges: DataFrame) -> DataFrame:
    """(id, to): where each vertex gets by going to its least neighbour again and again, as long as that is less."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
    points = cut(ends.groupBy("id").agg(F.min("to").alias("to")))
    while True:
        further = points.select(F.col("id").alias("to"), F.col("to").alias("up"))
        jumped = cut(points.join(further, "to").select("id", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
        points = jumped.select("id", "to")
        if not jumped.filter("moved").limit(1).count():
            return points
