"""Typed graph operators over DataFrames of nodes, edges and arcs.

Every stored edge becomes two arcs that carry its edge_id, so that removing an edge removes both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.schema import REVERSE, WEIGHTS
from provrank.storage import materialize


def without_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("edge_id").distinct(), "edge_id", "left_anti")


def only_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    return edges.join(kept.select("edge_id").distinct(), "edge_id", "left_semi")


def arcs(nodes: DataFrame, edges: DataFrame, weights: Mapping[str, float] | None = None, inside: bool = False) -> DataFrame:
    """(edge_id, src, rel, dst, weight): forward and reverse arc of each edge whose ends are both nodes.

    inside says that all ends are known to be nodes, which saves two joins. A weight of 0 or null counts as 1; it is multiplied by the type's weight. A reverse type without an
    entry takes its forward type's, else 1. Arcs whose type weighs nothing are left out. Columns src_home and dst_home of edges stay.
    """
    homes = ("src_home", "dst_home") if "src_home" in edges.columns else ()
    known = dict(WEIGHTS) | dict(weights or {})
    if not inside:
        ids = nodes.select("node_id")
        edges = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    base = F.when(F.coalesce("weight", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("weight"))

    def lookup(table: dict[str, float], default: float):
        out = F.lit(default)
        for rel, w in table.items():
            out = F.when(F.col("rel") == rel, F.lit(float(w))).otherwise(out)
        return out

    backward = {rel: known.get(rev, known.get(rel, 1.0)) for rel, rev in REVERSE.items()}
    name = F.col("rel")
    for rel, rev in REVERSE.items():
        name = F.when(F.col("rel") == rel, F.lit(rev)).otherwise(name)
    forward = F.struct("src", "rel", "dst", (base * lookup({r: known.get(r, 1.0) for r in REVERSE}, 1.0)).alias("weight"), *homes)
    reverse = F.struct(F.col("dst").alias("src"), name.alias("rel"), F.col("src").alias("dst"), (base * lookup(backward, 1.0)).alias("weight"), *[F.col(o).alias(h) for h, o in zip(homes, homes[::-1], strict=True)])
    out = edges.select("edge_id", F.explode(F.array(forward, reverse)).alias("arc")).select("edge_id", "arc.*")
    return out.where("weight > 0")


def out_strength(arcs_: DataFrame) -> DataFrame:
    return arcs_.groupBy(F.col("src").alias("node_id")).agg(F.sum("weight").alias("strength"))


def transitions(arcs_: DataFrame) -> DataFrame:
    """arcs with p, the share of the source's out-strength."""
    total = Window.partitionBy("src")
    return arcs_.withColumn("p", F.col("weight") / F.sum("weight").over(total))


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, edge_id) of the edges at each of the nodes."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    return ends.join(nodes.select("node_id").distinct(), "node_id").select("node_id", "edge_id").distinct()


def neighbours(arcs_: DataFrame, nodes: DataFrame, relations: Iterable[str] | None = None) -> DataFrame:
    """(node_id, rel, neighbour, edge_id) for each of the nodes; relations narrows the arc types."""
    rows = arcs_ if relations is None else arcs_.where(F.col("rel").isin(*relations))
    return rows.join(nodes.select(F.col("node_id").alias("src")).distinct(), "src").select(F.col("src").alias("node_id"), "rel", F.col("dst").alias("neighbour"), "edge_id")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("edges"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def edge_digest(edges: DataFrame, chunk: int = 500) -> DataFrame:
    """(digest): 16 hex digits of the sha256 over the sorted edge ids.

    Ids are sorted and packed by range in all tasks. A sha256 can only run over its bytes in order, so one task hashes
    the packed pieces as they come, a piece at a time; nothing but the digest reaches the driver.
    """
    import hashlib

    ids = edges.select("edge_id").where("edge_id is not null")
    ordered = ids.repartitionByRange("edge_id").sortWithinPartitions("edge_id").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, at, part = [], None, 0, 0
        for pdf in batches:
            for part, e in zip(pdf.part, pdf.edge_id, strict=True):
                if e != last:  # equal ids lie in one range
                    held.append(e)
                    last = e
            while len(held) >= chunk:
                yield pd.DataFrame({"part": [part], "at": [at], "piece": ["".join(held[:chunk]).encode()]})
                held, at = held[chunk:], at + 1
        if held:
            yield pd.DataFrame({"part": [part], "at": [at], "piece": ["".join(held).encode()]})

    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hashlib.sha256()
        for pdf in batches:
            for piece in pdf.piece:
                h.update(piece)
        yield pd.DataFrame({"digest": [h.hexdigest()[:16]]})

    pieces = materialize(ordered.mapInPandas(pack, "part int, at int, piece binary"), "pieces")
    return pieces.repartition(1).sortWithinPartitions("part", "at").mapInPandas(digest, "digest string")


def in_corpus(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations (src, dst) with both ends loaded, without self-loops and repeats; the rest is dropped."""
    ids = papers.select("paper_id")
    kept = citations.where("src != dst").join(ids.withColumnRenamed("paper_id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("paper_id", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def hops(links: DataFrame, seeds: DataFrame, max_hops: int, max_nodes: int | None = None) -> DataFrame:
    """(node_id, hop) reached from seeds over links (src, dst), breadth first; within a hop ids ascending fill max_nodes."""
    step = links.select("src", "dst").distinct()
    seen = materialize(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)), "hops")
    front = seen
    for hop in range(1, max_hops + 1):
        new = front.select(F.col("node_id").alias("src")).join(step, "src").select(F.col("dst").alias("node_id")).distinct()
        new = new.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop))
        if max_nodes is not None:
            new = new.orderBy("node_id").limit(max(0, max_nodes - seen.count()))
        front = materialize(new, "hop")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "hops")
    return seen


def satellites(arcs_: DataFrame, nodes: DataFrame, members: DataFrame, per_kind: int = 60) -> DataFrame:
    """(node_id, kind, degree) of the other-kind nodes that touch two or more members, the first per_kind of each kind by degree, then id."""
    ids = members.select("node_id").distinct()
    touching = neighbours(arcs_, ids).join(nodes.select(F.col("node_id").alias("neighbour"), "kind"), "neighbour").where("kind != 'paper'")
    degree = touching.groupBy("neighbour", "kind").agg(F.count("*").alias("degree")).where("degree >= 2")
    w = Window.partitionBy("kind").orderBy(F.desc("degree"), "neighbour")
    return degree.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_kind).select(F.col("neighbour").alias("node_id"), "kind", "degree")


def neighbourhood(arcs_: DataFrame, nodes: DataFrame, members: DataFrame, per_kind: int = 60) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, kind, degree) and edges among members and their satellites."""
    sat = satellites(arcs_, nodes, members, per_kind)
    ids = members.select("node_id").distinct()
    shown = ids.select("node_id", F.lit("paper").alias("kind"), F.lit(None).cast("long").alias("degree")).unionByName(sat)
    near = neighbours(arcs_, ids).where("rel != 'cited_by'")
    cites = near.where("rel = 'cites'").join(ids.withColumnRenamed("node_id", "neighbour"), "neighbour", "left_semi")
    other = near.where("rel != 'cites'").join(sat.select(F.col("node_id").alias("neighbour")), "neighbour", "left_semi")
    edges = cites.unionByName(other).select("edge_id", F.col("node_id").alias("src"), "rel", F.col("neighbour").alias("dst")).distinct()
    return shown, edges
