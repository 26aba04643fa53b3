"""Power iteration over a graph in blocks of nodes: a step moves packed numbers between blocks, no row for each arc.

Nodes are dealt to blocks by a hash of their home, which is the node itself unless the caller knows better: nodes of
one home share a block, and what passes between them isn't moved at all. For the arcs from one block to
another, a source with several of them sends its mass once, and arcs that meet in a target are summed before they are
sent. Which it is and where each number goes is settled once, so a step sends numbers without names.
A task holds the arcs of one block, 24 bytes each, and at least those of one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.storage import materialize, release

#: Arcs that a block holds on average; more blocks than shuffle partitions only for graphs that need them.
BLOCK_ARCS = 4_000_000
#: Kinds of packed rows: arcs within a block; sums for another block; masses for another block; where sums go; arcs whose sources' masses come; teleport and nodes without arcs.
INNER, SUMS, MASSES, PLACES, ARCS, START = range(6)
_PACKED = "block int, peer int, role int, n int, x binary, y binary, p binary, lost double"


@dataclass(frozen=True)
class Blocks:
    """out and into are packed and kept in memory by block; own is (block, node_id, v); dangles says whether a node has no arc."""

    out: DataFrame
    into: DataFrame
    own: DataFrame
    dangles: bool

    def close(self) -> None:
        self.out.unpersist()
        self.into.unpersist()
        release(self.own)


def _labels(spark, n: int) -> list[int]:
    """n numbers that Spark's hash puts into n different partitions."""
    ids = spark.range(40 * n + 1000).select(F.col("id").cast("int").alias("id"))
    found = {r.part: r.id for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()}
    return [found.get(k, k) for k in range(n)]


def _indices(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ids, wanted)
    if len(wanted) and (at.max(initial=0) >= len(ids) or (ids[at] != wanted).any()):
        raise ValueError("an arc ends at a node that start doesn't name")
    return at.astype(np.int32)


def _floats(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64)


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32)


def build(arcs: DataFrame, start: DataFrame, block_arcs: int = BLOCK_ARCS) -> Blocks:
    """Blocks of arcs (src, dst, weight, and src_home and dst_home or neither) and start (node_id, v, and home with these)."""
    spark = arcs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-arcs.count() // block_arcs))
    names = F.array(*map(F.lit, _labels(spark, n)))
    at: Callable[[str], Column] = lambda c: F.get(names, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    homed = "src_home" in arcs.columns and "home" in start.columns
    kind = start.schema["node_id"].dataType.simpleString()
    own = materialize(start.select(at("home" if homed else "node_id").alias("block"), "node_id", F.col("v").cast("double").alias("v")), "own")
    ends = arcs.select(at("src_home" if homed else "src").alias("block"), at("dst_home" if homed else "dst").alias("peer"), "src", "dst", F.col("weight").cast("double").alias("weight"))
    columns = ["block", "peer", "role", "n", "x", "y", "p", "lost", "ids"]

    def split(key: tuple, a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        me, ids = int(key[0]), np.sort(s.node_id.to_numpy())
        a = a.sort_values(["peer", "src", "dst", "weight"])  # so that sums don't depend on the order in which arcs came
        src, dst, weight, peer = _indices(ids, a.src.to_numpy()), a.dst.to_numpy(), a.weight.to_numpy(), a.peer.to_numpy()
        strength = np.bincount(src, weights=weight, minlength=len(ids))
        p = weight / strength[src] if len(src) else weight
        idle = np.flatnonzero(strength == 0).astype(np.int32)
        rows = [(me, me, START, 0, idle.tobytes(), None, None, 0.0, None)]
        cuts = [0, *(np.flatnonzero(np.diff(peer)) + 1).tolist(), len(peer)] if len(peer) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            to, fr, end, share = int(peer[lo]), src[lo:hi], dst[lo:hi], p[lo:hi]
            if to == me:
                rows.append((me, me, INNER, 0, fr.tobytes(), _indices(ids, end).tobytes(), share.tobytes(), 0.0, None))
                continue
            _, i, leave = np.unique(fr, return_inverse=True, return_counts=True)
            _, j, meet = np.unique(end, return_inverse=True, return_counts=True)
            once = leave[i] > meet[j]
            if not once.all():
                targets, slot = np.unique(end[~once], return_inverse=True)
                rows.append((me, to, SUMS, len(targets), fr[~once].tobytes(), slot.astype(np.int32).tobytes(), share[~once].tobytes(), 0.0, None))
                rows.append((to, me, PLACES, 0, None, None, None, 0.0, targets))
            if once.any():
                sources, slot = np.unique(fr[once], return_inverse=True)
                rows.append((me, to, MASSES, 0, sources.tobytes(), None, None, 0.0, None))
                rows.append((to, me, ARCS, 0, slot.astype(np.int32).tobytes(), None, share[once].tobytes(), 0.0, end[once]))
        return pd.DataFrame(rows, columns=columns)

    def place(key: tuple, r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("node_id")
        ids, v, out = s.node_id.to_numpy(), s.v.to_numpy(), []
        for row in r.itertuples(index=False):
            if row.role == START:
                out.append((row.block, row.peer, START, len(ids), row.x, None, v.tobytes(), float(v[_ints(row.x)].sum())))
            else:
                out.append((row.block, row.peer, row.role, 0, row.x, _indices(ids, np.asarray(row.ids)).tobytes(), row.p, 0.0))
        return pd.DataFrame(out, columns=columns[:-1])

    made = ends.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(split, f"{_PACKED}, ids array<{kind}>").persist(StorageLevel.MEMORY_AND_DISK)
    kept = lambda df: df.repartition(n, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
    into = kept(made.where(F.col("role") >= PLACES).groupBy("block").cogroup(own.groupBy("block")).applyInPandas(place, _PACKED))
    out = kept(made.where(F.col("role") < PLACES).drop("ids"))
    idle = into.where(F.col("role") == START).agg(F.sum(F.length("x"))).first()[0]
    out.count()
    made.unpersist()
    return Blocks(out, into, own, bool(idle))


def began(b: Blocks) -> DataFrame:
    """The state before the first step: (block, x, change, lost), a packed row for each block."""
    return b.into.where(F.col("role") == START).select("block", F.col("p").alias("x"), F.lit(float("inf")).alias("change"), "lost")


def lost(b: Blocks, state: DataFrame) -> float:
    """The mass of the nodes without arcs; asks Spark only where there are such nodes."""
    return float(state.agg(F.sum("lost")).first()[0] or 0.0) if b.dangles else 0.0


def step(b: Blocks, state: DataFrame, alpha: float, gone: float, compare: bool) -> DataFrame:
    """The next state; change is this step's, where compare asks for it."""

    def send(key: tuple, held: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        me, x = int(key[0]), _floats(s.x.iloc[0])
        inner, rows = np.zeros(len(x)), []
        for r in held.itertuples(index=False):
            if r.role == MASSES:
                rows.append((r.peer, me, MASSES, x[_ints(r.x)].tobytes(), None))
            else:
                sums = np.bincount(_ints(r.y), weights=x[_ints(r.x)] * _floats(r.p), minlength=len(x) if r.role == INNER else r.n)
                if r.role == INNER:
                    inner = sums
                else:
                    rows.append((r.peer, me, SUMS, sums.tobytes(), None))
        rows.append((me, me, INNER, inner.tobytes(), x.tobytes() if compare else None))
        return pd.DataFrame(rows, columns=["block", "peer", "role", "x", "was"])

    def receive(key: tuple, held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        me, start = int(key[0]), held[held.role == START].iloc[0]
        came = {(r.peer, r.role): _floats(r.x) for r in sent.itertuples(index=False)}
        was = sent.was[sent.role == INNER].iloc[0]
        total = came[me, INNER].copy()
        for r in held.sort_values(["peer", "role"]).itertuples(index=False):  # sums don't depend on the order in which numbers came
            if r.role == PLACES:
                total[_ints(r.y)] += came[r.peer, SUMS]
            elif r.role == ARCS:
                total += np.bincount(_ints(r.y), weights=came[r.peer, MASSES][_ints(r.x)] * _floats(r.p), minlength=len(total))
        x = _floats(start.p) * (alpha + (1 - alpha) * gone) + (1 - alpha) * total
        change = float(np.abs(x - _floats(was)).sum()) if was is not None else 0.0
        return pd.DataFrame({"block": [me], "x": [x.tobytes()], "change": [change], "lost": [float(x[_ints(start.x)].sum())]})

    sent = b.out.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(send, "block int, peer int, role int, x binary, was binary")
    return b.into.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(receive, "block int, x binary, change double, lost double")


def named(b: Blocks, state: DataFrame, share: float = 0.0) -> DataFrame:
    """(node_id, x, teleport) of a state; teleport is share of each node's v."""
    kind = b.own.schema["node_id"].dataType.simpleString()

    def name(key: tuple, s: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node_id")
        return pd.DataFrame({"node_id": own.node_id, "x": _floats(s.x.iloc[0]) if len(s) else 0.0, "teleport": own.v * share})

    return state.groupBy("block").cogroup(b.own.groupBy("block")).applyInPandas(name, f"node_id {kind}, x double, teleport double")
