"""Connected components of an edge table, by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastelake.session import materialise

MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """vertex, root (the least vertex of its component) of all vertices of ``edges`` (a, b: longs, not null).

    Each round hangs the larger neighbours, then the smaller ones, of every vertex on its least neighbour; the number
    of rounds grows with the logarithm of the longest path. A round is a written table, so no lineage grows and
    no vertex's neighbours are gathered in one place.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def tidy(df: DataFrame) -> DataFrame:
        return materialise(df.filter("u > v").distinct(), "edges")

    e = tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    now = mark(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = tidy(small)
        before, now = now, mark(e)
        if now == before:
            hung = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
            return hung.unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
