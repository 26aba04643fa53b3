"""Keyed merges of stored tables: a union, then one aggregate by key. seq orders the writes; stored rows come first.

Empty text counts as missing, and a missing hop stays missing, so that a later record can't blank an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(col: str) -> Column:
    """The newest value that is neither null nor empty."""
    value = F.col(col)
    return F.max_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), F.col("seq"))).alias(col)


def merge_nodes(rows: DataFrame) -> DataFrame:
    """rows (seq, node_id, kind, label, attrs): label newest present, attrs newest, kind first."""
    return rows.groupBy("node_id").agg(F.min_by("kind", "seq").alias("kind"), _last("label"), F.max_by("attrs", "seq").alias("attrs"))


def merge_papers(rows: DataFrame) -> DataFrame:
    """rows (seq and the paper columns): text and year newest present, counts greatest, hop least, fields newest, source first."""
    return rows.groupBy("paper_id").agg(
        *[_last(c) for c in ("corpus_id", "title", "abstract", "year", "venue")],
        F.max("citation_count").alias("citation_count"), F.max("reference_count").alias("reference_count"),
        F.max_by("fields", "seq").alias("fields"), F.min_by("source", "seq").alias("source"), F.min("hop").alias("hop"),
    )


def merge_edges(rows: DataFrame) -> DataFrame:
    """rows (seq, edge_id, src, rel, dst, weight): the newest weight of each id."""
    return rows.groupBy("edge_id").agg(*[F.min_by(c, "seq").alias(c) for c in ("src", "rel", "dst")], F.max_by("weight", "seq").alias("weight"))


def merge_cache(rows: DataFrame, key: str = "key") -> DataFrame:
    """The newest row of each cache key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "seq").alias("r")).select(key, "r.*")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")
