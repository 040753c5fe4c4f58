"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable. ``links``: a, b; any order, repeats allowed.

    Each round links larger neighbours to the smallest one (large star), then
    smaller ones (small star). Every round is written to the shared folder.
    Minima are grouped with map-side partial aggregation and joined back, so
    the neighbours of one node are never gathered in a task. The number of
    rounds grows with the logarithm of the longest path. No links, no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = F.xxhash64("v", "u").cast("decimal(38,0)")
    state = lambda df: df.select(mark.alias("m")).agg(F.count("*"), F.sum("m")).first()
    seen = state(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).union(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = stored(large, "edges-large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        after = stored(small.where("v <> u").distinct(), "edges-small")
        # Distinct edges with the same number and sum of hashes are the same.
        before, seen, edges = seen, state(after), after
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
