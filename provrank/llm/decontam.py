"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

A document is cut into overlapping passages so long that every item fits whole into one. Impacts are
divided by the item's score for itself, so the threshold is the share of an item's BM25 weight that a
passage holds, and everything at or above it is retrieved. A hit counts where both the question
and the answer of the item overlap with the passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns, materialize, small_batches

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: Items in one index, and indexes that are broadcast together.
SHARD, GROUP = 512, 4


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the answer is the last sentence, or the last quarter of a single one."""
    parts = [w for s in _SENTENCE.findall(text or "") if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = max(1, len(w) - max(1, len(w) // 4)) if len(w) > 1 else len(w)
    return w[:cut], w[cut:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return set(zip(*(words[k:] for k in range(n)), strict=False)) if words else set()


class Statistics:
    """What BM25 needs of the whole benchmark: items with words, items by term, mean and greatest length."""

    def __init__(self, texts: Iterable[str]):
        self.n, self.total, self.longest, self.df = 0, 0, 0, Counter()
        for t in texts:
            if w := words_of(t):
                self.n += 1
                self.total += len(w)
                self.longest = max(self.longest, len(w))
                self.df.update(set(w))


class BlockMaxIndex:
    """Postings by term in item order, in blocks of ``block`` items, with each block's greatest impact. Without statistics, the items are the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, block: int = 4, whole: Statistics | None = None):
        whole = whole or Statistics(t for _, t in items)
        self.items = [(i, w, *split_item(t)) for i, t in items if (w := words_of(t))]
        self.block = block
        n = len(self.items)
        tf = [Counter(w) for _, w, _, _ in self.items]
        mean = whole.total / max(1, whole.n)
        idf = {t: float(np.log(1 + (whole.n - d + 0.5) / (d + 0.5))) for c in tf for t in c if (d := whole.df[t])}
        posts: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(tf):
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            raw = {t: idf[t] * f * (k1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(raw.values())
            for t, v in raw.items():
                posts[t].append((k, v / own))
        self.term = {t: j for j, t in enumerate(sorted(posts))}
        self.docs = [[d for d, _ in posts[t]] for t in self.term]
        self.impacts = [[v for _, v in posts[t]] for t in self.term]
        self.most = np.array([max(v) for v in self.impacts]) if posts else np.zeros(0)
        self.block_max = np.zeros((len(self.term), max(1, -(-n // block))), dtype=np.float32)
        for j, (ds, vs) in enumerate(zip(self.docs, self.impacts, strict=True)):
            for d, v in zip(ds, vs, strict=True):
                self.block_max[j, d // block] = max(self.block_max[j, d // block], v)
        self.longest = whole.longest
        self.parts = [(grams(q), grams(a)) for _, _, q, a in self.items]

    def wand(self, terms: list[int], threshold: float, first: int, last: int) -> list[tuple[int, float]]:
        """Items first <= k < last that score at least threshold, by pivoting over the terms' cursors."""
        cursors = []
        for j in terms:
            at = bisect_left(self.docs[j], first)
            if at < len(self.docs[j]) and self.docs[j][at] < last:
                cursors.append([self.docs[j][at], at, j])
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for doc, _, j in cursors:
                bound += float(self.block_max[j, doc // self.block]) + 1e-6
                if bound >= threshold:
                    pivot = doc
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(self.impacts[j][at] for doc, at, j in cursors if doc == pivot)
                if score >= threshold:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            moved = []
            for doc, at, j in cursors:
                if doc < target:
                    at = bisect_left(self.docs[j], target, at)
                    if at == len(self.docs[j]) or self.docs[j][at] >= last:
                        continue
                    doc = self.docs[j][at]
                moved.append([doc, at, j])
            cursors = moved
        return out

    def retrieve(self, ids: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items at or above threshold for the distinct term ids of a passage."""
        if not len(ids) or self.most[ids].sum() < threshold:
            return []
        bounds = self.block_max[ids].sum(axis=0)
        hits: list[tuple[int, float]] = []
        for k in np.flatnonzero(bounds >= threshold - 1e-4):
            hits += self.wand(ids[self.block_max[ids, k] > 0].tolist(), threshold, int(k) * self.block, (int(k) + 1) * self.block)
        return hits

    def search(self, text: str | None, threshold: float, question: float, answer: float, passage: int) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word of the passage) of each item the text holds; its best passage."""
        words = words_of(text)
        if not words or not self.items:
            return []
        get = self.term.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        if not (ids >= 0).any():
            return []
        width = max(passage, 2 * self.longest)
        step = width - self.longest
        best: dict[int, tuple] = {}
        for start in range(0, max(1, len(words) - width + step), step):
            window = np.unique(ids[start : start + width])
            for k, score in self.retrieve(window[1:] if window[0] < 0 else window, threshold):
                have = grams(words[start : start + width])
                singles = {g[:1] for g in have} | {(w,) for w in words[start : start + width]}
                shares = []
                for part in self.parts[k]:
                    size = len(next(iter(part))) if part else 0
                    have_n = have if size == 3 else singles if size == 1 else grams(words[start : start + width], size) if size else set()
                    shares.append(len(part & have_n) / len(part) if part else 1.0)
                if shares[0] >= question and shares[1] >= answer and (k not in best or score > best[k][1]):
                    best[k] = (self.items[k][0], float(score), float(shares[0]), float(shares[1]), start)
        return [best[k] for k in sorted(best)]


def build(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id") -> Iterator[list[BlockMaxIndex]]:
    """Indexes of SHARD items each, GROUP at a time, so that what is broadcast has a bound; all weigh terms over the whole benchmark, which is read once before for that."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    whole = Statistics(r.t for r in rows.select("t").toLocalIterator())
    shards: list[BlockMaxIndex] = []
    batch: list[tuple] = []
    for r in rows.toLocalIterator():
        batch.append((r.i, r.t))
        if len(batch) == SHARD:
            shards.append(BlockMaxIndex(batch, whole=whole))
            batch = []
            if len(shards) == GROUP:
                yield shards
                shards = []
    if batch:
        shards.append(BlockMaxIndex(batch, whole=whole))
    if shards:
        yield shards


_FIELDS = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")


def _finder(shared, kind: str, threshold: float, question: float, answer: float, passage: int):
    @F.pandas_udf(kind)
    def look(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_FIELDS, h, strict=True)) for index in shared.value for h in index.search(t, threshold, question, answer, passage)] for t in text], dtype=object)

    return look


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, passage: int = 128, **columns) -> DataFrame:
    """docs with ``hits``: the items that each whole text holds, in item order of each index.

    Null, empty and unmatched texts have an empty array, as has every text where the benchmark is empty or
    wordless. Items without an id or a text are left out; repeated items are found once each; of passages that
    tie for an item the first counts. Item ids may be of any type that orders. A column named hits gives way.
    SHARD * GROUP items are one pass over docs; each further pass reads what the one before wrote, so one group
    of indexes is held at a time.
    """
    small_batches(docs.sparkSession)
    kind = benchmark.schema[columns.get("id_col", "item_id")].dataType.simpleString()
    kind = f"array<struct<item_id: {kind}, score: double, question_overlap: double, answer_overlap: double, first_word: int>>"
    out = add_columns(docs, {"hits": F.array().cast(kind)})
    shared = None
    for shards in build(benchmark, **columns):
        if shared is not None:
            out = materialize(out, "hits")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(shards)
        look = _finder(shared, kind, threshold, question, answer, passage)
        out = out.withColumn("hits", F.concat("hits", look(F.col(f"`{text_col}`"))))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each document and item that it holds. An id column with the name of one of the item's columns is returned as doc_ and that name."""
    name = f"doc_{id_col}" if id_col.lower() in _FIELDS else id_col
    return annotate(docs, benchmark, **options).select(F.col(f"`{id_col}`").alias(name), F.explode("hits").alias("__h")).select(F.col(f"`{name}`"), "__h.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs, repeated rows included."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() == "hits"}
    return annotate(docs.withColumnsRenamed(own), benchmark, **options).where(F.size("hits") == 0).drop("hits").withColumnsRenamed({v: k for k, v in own.items()})
