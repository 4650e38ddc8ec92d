"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link (a, b); a component is its smallest id.

    Each round points every vertex to its smallest neighbour, shortens the
    pointers, and contracts the links; the links left fall by half or more a
    round.  Nothing is collected but the number of links left.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        point = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("p"))
        point = materialize(point, "pointers")
        for _ in range(2):
            further = point.select(F.col("v").alias("p"), F.col("p").alias("p2"))
            point = point.join(further, "p", "left").select("v", F.coalesce("p2", "p").alias("p"))
        point = materialize(point, "pointers")
        if labels is None:
            labels = point
        else:
            named = point.select(F.col("v").alias("p"), F.col("p").alias("p2"))
            labels = materialize(labels.join(named, "p", "left").select("v", F.coalesce("p2", "p").alias("p")), "labels")
        a = point.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        b = point.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = materialize(edges, "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select(F.col("v").alias("id"), F.col("p").alias("component"))
