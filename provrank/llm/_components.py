"""Connected components of a distributed edge list by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of itself and its neighbours.

    A hub has many larger neighbours, so the minimum is joined back: both sides have an exchange, and AQE can split the hub's rows.
    """
    sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = materialize(sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
    out = materialize(sym.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), "edges")
    release(low)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them; the minimum is joined back here too, as a hub may be the greatest of its neighbours."""
    low = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
    out = edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    out = materialize(out.where("a != b").distinct(), "edges")
    release(low)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")), F.struct(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("child").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with an edge.

    edges has two columns of the same orderable type; loops, repeats and nulls are ignored.
    """
    x, y = edges.columns
    cur = edges.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull()).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    cur = materialize(cur.where("a != b").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(cur):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        big = _large_star(cur)
        release(cur)
        cur = _small_star(big)
        release(big)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
