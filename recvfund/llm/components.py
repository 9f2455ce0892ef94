"""Connected components by alternating stars: every round hangs each node's larger, then its smaller neighbours on the smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _hung(edges: DataFrame) -> DataFrame:
    """For each edge (a, b), b on the smallest of a and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return edges.join(least, F.col("a") == F.col("of")).select("a", "b", "m")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges`` (two columns); the label is the smallest node of its component, its own included.

    Rows of a round are written to the shared folder; the driver sees a count and a checksum. Rounds grow as the
    logarithm of the longest path.
    """
    x, y = edges.columns[:2]
    e = kept(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a > b").distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = _hung(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        h = _hung(e)  # all b are smaller than a here
        e = h.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(h.select("a", F.col("m").alias("b"))).distinct()
        e = kept(e)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
