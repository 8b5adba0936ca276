"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwarden.staging import Staging


def connected_components(edges: DataFrame, stage: Staging) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex it reaches.

    Each round maps every vertex to its smallest neighbour (itself included),
    rewrites the edges by that map and drops loops and repeats; the rounds end
    when no edge is left.  Only minima are aggregated, so a vertex with very many
    neighbours costs partial sums, not one large group.  Null ends are ignored,
    self loops only name their vertex, an empty table gives an empty result.
    Returns ``(id, component)``.
    """
    links = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).dropna().distinct()
    links = stage.save(links, "edges")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stage.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                       .select("id", F.least("id", "m").alias("component")), "labels")
    step = label
    while True:
        ends = step.select(F.col("id").alias("a"), F.col("component").alias("ra"))
        other = step.select(F.col("id").alias("b"), F.col("component").alias("rb"))
        moved = (links.join(ends, "a").join(other, "b")
                 .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                 .where("a <> b").distinct())
        smaller = stage.save(moved, "edges")
        stage.drop(links)
        links = smaller
        if links.isEmpty():
            return label
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                          .select("id", F.least("id", "m").alias("component")), "step")
        new = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        old = label
        label = stage.save(label.join(new, "component", "left")
                           .select("id", F.coalesce("next", "component").alias("component")), "labels")
        if old is not step:
            stage.drop(old)
