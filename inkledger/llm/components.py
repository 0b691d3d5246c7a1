"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.shared import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each ``u``; written first, so that a join on a hot ``u`` can be split."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    near = both.join(least, "u").where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` run from the larger node ``u`` to the smaller ``v``, as a large star leaves them."""
    least = _least(edges)
    near = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long) but the roots themselves.

    ``root`` is the least node that can be reached. Each round is written to
    the shared folder; rounds end when the stars no longer change. Self-links
    and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        for star in (_large_star, _small_star):
            after, least = star(now)
            after = materialize(after, "edges")
            discard(spark, now, least)
            now = after
        # Counts and a sum of hashes: equal only if the edges are (sums wrap as longs do).
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots.inkledger_dir = now.inkledger_dir
            return roots
