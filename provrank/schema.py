"""Node and relation vocabularies, ids and stored schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("paper", "author", "venue", "concept")
RELATIONS = ("cites", "authored_by", "published_in", "shares_concept")
#: The name of each relation read from its other end, and the weight of each arc type.
REVERSE = {"cites": "cited_by", "authored_by": "wrote", "published_in": "published", "shares_concept": "shares_concept"}
WEIGHTS = {"cites": 1.0, "cited_by": 1.0, "authored_by": 0.6, "wrote": 0.6, "published_in": 0.3, "published": 0.3, "shares_concept": 0.5}

NODE = "node_id string, kind string, label string, attrs map<string,string>"
PAPER = "paper_id string, corpus_id long, title string, abstract string, year int, venue string, citation_count long, reference_count long, fields array<string>, source string, hop int"
EDGE = "edge_id string, src string, rel string, dst string, weight double"


def edge_id(src: Column, rel: Column, dst: Column) -> Column:
    """Content id of an edge: equal triples have equal ids on every run."""
    return F.concat(F.lit("e"), F.substring(F.sha1(F.concat_ws("\x1f", src, rel, dst)), 1, 16))


def edge_code(src: Column, rel: Column, dst: Column) -> Column:
    """edge_id() as a long that orders as its text does."""
    digest = F.sha1(F.concat_ws("\x1f", src, rel, dst))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1) - (1 << 31), 32) + half(9)


def edge_name(code: Column) -> Column:
    """The edge_id() of an edge_code()."""
    return F.concat(F.lit("e"), F.lpad(F.lower(F.hex(code.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))), 16, "0"))


def prompt_key(model: Column, prompt: Column) -> Column:
    """Cache key of a model call."""
    return F.sha2(F.concat_ws("\x1f", model, prompt), 256)


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.select(edge_id(F.col("src"), F.col("rel"), F.col("dst")).alias("edge_id"), "src", "rel", "dst", F.col("weight").cast("double").alias("weight"))


def check_vocabulary(nodes: DataFrame, edges: DataFrame) -> None:
    """ValueError on an unknown kind or relation."""
    for df, col, known in ((nodes, "kind", KINDS), (edges, "rel", RELATIONS)):
        bad = df.where(~F.coalesce(F.col(col).isin(*known), F.lit(False))).select(col).first()
        if bad is not None:
            raise ValueError(f"unknown {col}: {bad[0]!r}")
