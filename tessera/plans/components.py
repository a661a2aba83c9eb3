"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id (``root``) of every vertex ``v``; edges are ``(a, b)``, undirected.

    Each round hangs neighbours under the smallest vertex next to them, first the larger ones, then
    the smaller ones, until every component is a star. Minima are aggregated before they are joined,
    the number of edges never grows and rounds are logarithmic, so hubs and long chains are fine. It
    ends with the round that changes nothing.
    """
    e = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == before:
            roots = e.select(F.col("u").alias("v"), F.col("v").alias("_r"))
            return vertices.join(roots, "v", "left").select("v", F.coalesce("_r", "v").alias("root"))
        before = (row["n"], row["h"])
