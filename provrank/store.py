"""Stored graphs: snapshots of nodes, papers and edges, and a pointer that names the current one.

A write makes a whole new snapshot and then moves the pointer by one rename, so a reader sees the old graph or
the new one, and a write that fails leaves the old one current. Tables are sorted by their ids over all
files, so looking some ids up reads the row groups that can hold them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provrank.schema import check_vocabulary

SCHEMA_VERSION = 1
KEYS = {"nodes": "node_id", "papers": "paper_id", "edges": "edge_id"}
_POINTER = "CURRENT.json"
#: Ids that one lookup may ask for; more belong in a join.
MAX_LOOKUP = 10_000


class NoGraph(FileNotFoundError):
    """The folder holds no stored graph, or not that snapshot."""


@dataclass(frozen=True)
class Graph:
    """The tables of one snapshot, and its name."""

    nodes: DataFrame
    papers: DataFrame
    edges: DataFrame
    snapshot: str


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def _point(spark: SparkSession, folder: str, state: dict) -> None:
    """Write the pointer beside its place and rename it over the old one."""
    conf = spark._jsc.hadoopConfiguration()
    fs, new = _fs(spark, f"{folder}/{_POINTER}-{uuid.uuid4().hex}")
    fs.mkdirs(new.getParent())
    out = fs.create(new)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_POINTER}")), options)


def state(spark: SparkSession, folder: str) -> dict:
    """Schema version, the current snapshot and all snapshots, oldest first; ValueError for a graph of a newer version."""
    found = _read(spark, f"{folder}/{_POINTER}")
    if found is None:
        raise NoGraph(f"no stored graph in {folder}")
    if found["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"{folder} has schema version {found['schema_version']}, this library knows {SCHEMA_VERSION}")
    return found


def save(spark: SparkSession, folder: str, nodes: DataFrame, papers: DataFrame, edges: DataFrame, note: str = "", files: int | None = None) -> str:
    """Store a graph as the current snapshot, each table in as many files or in what its size asks for, and return its name. Unknown kinds and relations are a ValueError before anything is current."""
    name = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"
    for table, df in (("nodes", nodes), ("papers", papers), ("edges", edges)):
        key = KEYS[table]
        dealt = df.repartitionByRange(key) if files is None else df.repartitionByRange(files, key)
        dealt.sortWithinPartitions(key).write.parquet(f"{folder}/{name}/{table}")
    kept = [spark.read.parquet(f"{folder}/{name}/{t}") for t in KEYS]
    check_vocabulary(kept[0], kept[2])
    try:
        old = state(spark, folder)["snapshots"]
    except NoGraph:
        old = []
    _point(spark, folder, {"schema_version": SCHEMA_VERSION, "current": name, "snapshots": [*old, {"name": name, "note": note}]})
    return name


def load(spark: SparkSession, folder: str, snapshot: str | None = None) -> Graph:
    """The current snapshot, or the one named."""
    known = state(spark, folder)
    name = snapshot or known["current"]
    if name not in {s["name"] for s in known["snapshots"]}:
        raise NoGraph(f"no snapshot {name} in {folder}")
    return Graph(*[spark.read.parquet(f"{folder}/{name}/{t}") for t in KEYS], name)


def rollback(spark: SparkSession, folder: str, snapshot: str | None = None) -> str:
    """Make a snapshot current again: the one named, or the one before the current."""
    known = state(spark, folder)
    names = [s["name"] for s in known["snapshots"]]
    if snapshot is None:
        at = names.index(known["current"])
        if at == 0:
            raise NoGraph(f"no snapshot before {names[0]} in {folder}")
        snapshot = names[at - 1]
    if snapshot not in names:
        raise NoGraph(f"no snapshot {snapshot} in {folder}")
    _point(spark, folder, known | {"current": snapshot})
    return snapshot


def lookup(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """The rows with these ids, by a filter that the files' statistics answer; ids that are missing give no row."""
    if len(ids) > MAX_LOOKUP:
        raise ValueError(f"a lookup takes {MAX_LOOKUP} ids at most; join instead")
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


def papers(graph: Graph, source: str | None = None) -> DataFrame:
    """Papers, of one source if it is given; missing titles and abstracts read as empty."""
    rows = graph.papers if source is None else graph.papers.where(F.col("source") == source)
    for c in ("title", "abstract"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    return rows


def nodes_of(graph: Graph, kind: str) -> DataFrame:
    return graph.nodes.where(F.col("kind") == kind)
