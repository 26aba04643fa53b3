"""Filter interaction audit: what each of several filters removes under every order of applying them.

A document becomes the mask of the filters it fails. Documents are counted by (part, mask): at most 32
cells a part for five filters, whatever the data. All orders are then visited by adjacent transpositions
(Steinhaus, Johnson and Trotter): from one order to the next two neighbours change places, and only the
two steps they stand at are computed again, from the cells. A filter's Shapley figure is summed along
the walk: what a step removes changes only when the step is computed, so each value is added with the
number of orders for which it stood.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import materialize, release

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
#: Parts whose walks are computed together in a task.
_PARTS = 64


def transpositions(n: int) -> Iterator[int]:
    """The positions k of the swaps (k, k + 1) that lead from the ascending order through all n! orders."""
    order, left = list(range(n)), [True] * n
    while True:
        at = {item: k for k, item in enumerate(order)}
        movable = [x for x in order if 0 <= at[x] + (-1 if left[x] else 1) < n and order[at[x] + (-1 if left[x] else 1)] < x]
        if not movable:
            return
        top = max(movable)
        k = at[top] - left[top]
        order[k], order[k + 1] = order[k + 1], order[k]
        for x in range(top + 1, n):
            left[x] = not left[x]
        yield k


def failures(text: Column) -> list[Column]:
    """Whether a whole text (never null) fails A (length), B (variety), C (capitals), D (symbols)."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text, source): bit k is set if filter k fails.

    E fails where a smaller doc_id has the same text, anywhere in the table. The least id of a text is a
    grouped minimum, summed before it is shuffled; rows meet it by text digest and id together, so a text
    with any number of copies lies in no one task. Rows that repeat the least id pass. A null id is no
    smaller one and fails no E; a null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(failures(text))), F.lit(0))
    rows = materialize(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits")), "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = rows.join(first, ["doc_id", "digest"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    out = met.select("doc_id", "part", (F.col("bits") + F.when(repeated, 16).otherwise(0)).alias("mask"))
    out.written_to = rows.written_to
    return out


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each mask that occurs its documents, good ones (quality 1) and toxic ones (toxic 1).

    An id that labels lists more than once is good or toxic if any of its rows says so.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    each = masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), n("good").alias("good"), n("toxic").alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


class Walk:
    """All orders of n filters for several parts at once; cells: parts x 2^n x (documents, good, toxic)."""

    def __init__(self, cells: np.ndarray) -> None:
        parts, size, _ = cells.shape
        self.n = size.bit_length() - 1
        # passing[:, s]: documents that fail no filter of the set s; summed over subsets of its complement
        below = cells.copy()
        for k in range(self.n):
            without = [m for m in range(size) if not m >> k & 1]
            with_k = [m | 1 << k for m in without]
            below[:, with_k] += below[:, without]
        self.passing = below[:, [size - 1 - s for s in range(size)]]
        self.fails = np.stack([cells[:, [m for m in range(size) if m >> k & 1], 0].sum(axis=1) for k in range(self.n)], axis=1)
        self.unique = np.stack([cells[:, 1 << k, 0] for k in range(self.n)], axis=1)
        self.order = list(range(self.n))
        self.steps = np.zeros((parts, self.n, 3), dtype=np.int64)  # removed at each step: documents, good, toxic
        self.kept = np.zeros((parts, self.n), dtype=np.int64)
        self.shapley = np.zeros((parts, self.n), dtype=np.int64)
        self.since = [0] * self.n
        self.updates = 0

    def compute(self, k: int) -> None:
        """Step k from the cells."""
        before = sum(1 << f for f in self.order[:k])
        after = self.passing[:, before | 1 << self.order[k]]
        self.steps[:, k] = self.passing[:, before] - after
        self.kept[:, k] = after[:, 0]
        self.updates += 1

    def settle(self, k: int, now: int) -> None:
        """Add what step k has removed to its filter, once for each order since it was computed."""
        self.shapley[:, self.order[k]] += self.steps[:, k, 0] * (now - self.since[k])
        self.since[k] = now

    def orders(self) -> Iterator[list[int]]:
        """Visit every order; steps and kept are those of the order that is given."""
        for k in range(self.n):
            self.compute(k)
        yield self.order
        for now, k in enumerate(transpositions(self.n), 1):
            for j in (k, k + 1):
                self.settle(j, now)
            self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
            for j in (k, k + 1):
                self.compute(j)
            yield self.order
        for k in range(self.n):
            self.settle(k, factorial(self.n))


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = len(FILTERS)
    for pdf in batches:
        for at in range(0, len(pdf), _PARTS):
            some = pdf.iloc[at : at + _PARTS]
            table = np.zeros((len(some), 1 << n, 3), dtype=np.int64)
            for k, own in enumerate(some["cells"]):
                for c in own:
                    table[k, c["mask"]] = c["n"], c["good"], c["toxic"]
            walk = Walk(table)
            visited = [(list(order), walk.steps.copy(), walk.kept.copy()) for order in walk.orders()]
            orders = np.array([order for order, _, _ in visited])  # orders x steps: the filter of each step
            steps = np.stack([x for _, x, _ in visited], axis=1)  # parts x orders x steps x 3
            removed, fails = steps[..., 0], walk.fails[:, orders]
            columns = {
                "kept": np.stack([x for _, _, x in visited], axis=1), "removed": removed, "redundant": fails - removed, "unique_fails": walk.unique[:, orders],
                "good_lost": steps[..., 1], "toxic_lost": steps[..., 2], "shapley": walk.shapley[:, orders],
            }
            names = np.repeat(["".join(FILTERS[f] for f in order) for order in orders], n)
            yield pd.DataFrame({
                "part": np.repeat(some["part"].to_numpy(), orders.size), "filter_order": np.tile(names, len(some)),
                "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(some) * len(orders)),
            } | {k: v.reshape(-1) for k, v in columns.items()})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source; null: empty), order of ABCDE and step; see masks() and cells().

    Columns: part, filter_order, step (1 to 5), kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. Other columns of docs and labels are not read; without documents there are no
    rows, without labels good_lost and toxic_lost are zero.
    """
    masked = masks(docs.select("doc_id", "text", "source"))
    counted = materialize(cells(masked, labels.select("doc_id", "quality", "toxic")), "cells")
    release(masked)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counted.mapInPandas(_walks, schema)
