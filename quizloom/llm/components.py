"""Connected components of a table of links, without gathering any node's neighbours.

Alternating large-star and small-star steps on the edge table, as published for map-reduce:
a step is one aggregate and one join on the node, so a hot node
is spread by adaptive skew handling; lineage is cut with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.sources.tables import use_checkpoint_dir


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: (u, v) with u > v, distinct."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def component_labels(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that occurs in links (a, b): the least node of its component.

    Nulls are ignored; loops, repeated and reversed links count once; no links, no rows.
    """
    spark = links.sparkSession
    use_checkpoint_dir(spark)
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        edges = _starred(_starred(edges, large=True), large=False).checkpoint()
        # a star forest no longer changes: its edges' number and the sum of their hashes stay
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
