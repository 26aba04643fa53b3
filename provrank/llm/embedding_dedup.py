"""Near-equal embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations are learned on a bounded sample (Gong & Lazebnik, 2011), uncentred, so that a pair at angle
t differs in a bit with a chance near t/pi. A code is cut into ``tables`` substrings of ``bits`` bits;
vectors that agree in a substring share a bucket of its table. bits grows with the logarithm of
the number of vectors, which keeps buckets small, and tables follows from bits so that a pair at the
threshold meets in some table with the chance ``recall``; nearer pairs meet more surely.
Every pair of a bucket is reranked by its exact cosine. A pair counts in the first table where it meets.
Vectors of each length have an index of their own; equal vectors are one entry with a count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import by_group, materialize, partitions, release, small_batches
from provrank.llm._components import components

#: Rows of a bucket that one cell holds; a larger bucket is cut into chunks, whose pairs are the cells.
CHUNK = 1024


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for n vectors."""
    bits = max(4, round(math.log2(max(n, 1) / 48 + 1)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def learn_rotations(x: np.ndarray, count: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """count rotations of ITQ from different starts, side by side: (dim, count * dim)."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x.T @ x)
    v = x @ axes.T
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        out.append(axes.T @ r)
    return np.hstack(out)


def substrings(x: np.ndarray, rotations: np.ndarray, bits: int, tables: int) -> np.ndarray:
    b = (x @ rotations[:, : bits * tables] >= 0).reshape(len(x), tables, bits)
    return (b @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled by their greatest component first, as squares of large doubles overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            front = np.flatnonzero(linked[i] & (root < 0))
            while len(front):
                root[front] = i
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
    return root


def _cell(threshold: float, kind: str):
    def each(pdf: pd.DataFrame) -> pd.DataFrame | None:
        n = len(pdf)
        if n < 2:
            return None
        t = int(pdf.t.iloc[0])
        x = unit(np.stack([np.frombuffer(v, dtype=kind) for v in pdf.vec]))
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if pdf.i.iloc[0] != pdf.j.iloc[0]:
            part = pdf.part.to_numpy()
            linked &= part[:, None] != part[None, :]
        p, q = np.nonzero(linked)
        if not len(p):
            return None
        codes, mult = np.stack(pdf.codes), pdf.mult.to_numpy()
        new = np.ones(len(p), dtype=bool)
        for s in range(t):
            new &= codes[p, s] != codes[q, s]
        links = np.bincount(p[new], weights=mult[q[new]], minlength=n).astype(np.int64)
        has = linked.any(axis=1)
        rid = pdf.rid.to_numpy()
        return pd.DataFrame({"rid": rid[has], "links": links[has], "root": rid[_forest(linked)][has]})

    return each


def link(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = 0.9, recall: float = 0.97, sample_rows: int = 8192, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of df.

    n_links is the number of other rows within the threshold, component_id the least id that links
    reach. A vector that is null, empty or zero, or holds a null or a number that isn't finite, links with
    nothing; vectors of different lengths don't link. Equal vectors link with each other, also those of rows
    that repeat an id. A null id is never the least; a row whose component has no other id gets null and
    kept = false. Other columns of df don't matter. The rotation of each length is fitted on at most ``sample_rows``
    distinct vectors; every vector is indexed.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    id_kind = rows.schema["id"].dataType.simpleString()
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    valid = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [(np.asarray(v, dtype=kind) + 0).tobytes() for v in pdf.v]
            yield pd.DataFrame({"id": pdf.id, "key": [hashlib.md5(b).digest() for b in packed], "vec": packed})

    packed = materialize(rows.where(valid).mapInPandas(pack, f"id {id_kind}, key binary, vec binary"), "vectors")
    distinct = packed.groupBy("key").agg(F.count("*").alias("mult"), F.min("id").alias("low"), F.first("vec").alias("vec"))
    reps = materialize(distinct.withColumn("rid", F.monotonically_increasing_id()).withColumn("bytes", F.length("vec")), "distinct")
    sizes = {r.bytes: r.n for r in reps.groupBy("bytes").agg(F.count("*").alias("n")).collect()}  # one row for each length
    found = [_links(reps.where(F.col("bytes") == b), n, kind, threshold, recall, sample_rows, seed) for b, n in sorted(sizes.items()) if n > 1]
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "rid long, links long, root long")
    comp = materialize(components(found.select(F.col("rid").alias("x"), F.col("root").alias("y"))), "components")
    low = reps.select(F.col("rid").alias("node"), "low").join(comp, "node").groupBy("component").agg(F.min("low").alias("low"))
    low = materialize(low, "lowest")
    named = comp.join(low, "component").select(F.col("node").alias("rid"), F.col("low").alias("c"))
    total = found.groupBy("rid").agg(F.sum("links").alias("links"))
    info = reps.select("rid", "key", "mult", "low").join(total, "rid", "left").join(named, "rid", "left")
    info = materialize(info.select("key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "low").alias("component_id")), "info")
    for used in (reps, comp, low):
        release(used)
    out = packed.select("id", "key").join(info, "key").select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(rows.where(~valid).select(F.col("id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")))


def _links(reps: DataFrame, n: int, kind: str, threshold: float, recall: float, sample_rows: int, seed: int) -> DataFrame:
    """(rid, links, root) of the n distinct vectors of one length, by cell: new links of rid and the first row of its part of the cell."""
    spark = reps.sparkSession
    bits, tables = plan(n, threshold, recall)
    sample = reps.select("vec").orderBy(F.xxhash64("key")).limit(sample_rows).toPandas()
    x = unit(np.stack([np.frombuffer(v, dtype=kind) for v in sample.vec]))
    shared = spark.sparkContext.broadcast(learn_rotations(x, math.ceil(bits * tables / x.shape[1]), seed))

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = unit(np.stack([np.frombuffer(b, dtype=kind) for b in pdf.vec]))
                yield pdf.assign(codes=list(substrings(v, shared.value, bits, tables)))

    coded = materialize(reps.select("rid", "mult", "vec").mapInPandas(encode, "rid long, mult long, vec binary, codes array<long>"), "codes")
    sizes = coded.select(F.posexplode("codes").alias("t", "b")).groupBy("t", "b").agg(F.count("*").alias("size"))
    # most buckets of a tight index hold one vector; only the others are dealt out
    sizes = materialize(sizes.where("size > 1").withColumn("m", F.ceil(F.col("size") / CHUNK).cast("int")).select("t", "b", "m"), "buckets")
    dealt = coded.select("rid", "mult", "vec", "codes", F.posexplode("codes").alias("t", "b")).join(sizes, ["t", "b"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    keys = ["t", "b", "i", "j"]
    dealt = dealt.select("t", "b", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rid", "mult", "vec", "codes")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    found = materialize(dealt.mapInPandas(by_group(keys, _cell(threshold, kind)), "rid long, links long, root long"), "links")
    release(sizes)
    release(coded)
    return found
