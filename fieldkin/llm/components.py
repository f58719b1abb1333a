"""Connected components of a graph given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldkin.session import keep


def stars(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, of every node that isn't a root.

    ``edges`` has ``u`` and ``v``. Each round hangs the larger neighbours of a node,
    then the smaller ones, under its smallest neighbour, until nothing changes;
    rounds grow with the logarithm of the longest path. Minima are combined before
    they are shuffled and are joined back, so a node with many neighbours is never
    gathered. Each round is written to the shared folder.
    """
    edges = keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"),
        ).select("e.*").where("u <> v").distinct()
        edges = keep(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
