"""Connected components by repeated contraction; the name of a component is its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, component) for every node of an edge.

    Each round gives every node its smallest neighbour, follows these pointers twice, and replaces the ends of the
    edges by them; edges inside one group go.  The number of edges falls by rounds, and nothing is collected but
    whether edges are left.
    """
    edges = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    names = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        up = save(up, "up")
        for _ in range(2):
            further = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
            up = up.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        up = save(up, "up")
        if names is None:
            names = up.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            new = up.select(F.col("a").alias("component"), "to")
            names = names.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names = save(names, "names")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("a").alias(end), F.col("to").alias(f"{end}_to")), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        edges = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if names is None:
        names = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names
