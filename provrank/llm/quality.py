"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

The model is fitted on at most ``sample_rows`` labelled rows (a documented bound), taken by a hash
of the id. Each of a fixed number of partitions sums its part of the normal equations; a quarter of
the sample is kept out of them and calibrates the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import materialize, release, small_batches

N_STATS = 18
_PARTS = 8
_EDGE = re.compile(r"[^\w\s.,;:!?'\"()-]")


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 lower or caseless letter, 1 upper, 2 digit, 3 space, 4 common punctuation, 5 other."""
    t = np.full(0x110000, 5, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        t[i] = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:'\"()-" else 5
    return t


def statistics(text: str | None) -> np.ndarray:
    """Statistics of the whole text; a null text counts as empty."""
    out = np.zeros(N_STATS)
    words = (text or "").split()
    if not words:
        return out
    n, size = len(words), len(text)
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)], minlength=6) / size
    counts = Counter(words)
    distinct = len(counts)
    top = counts.most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
    odd = len(_EDGE.findall(text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    short = float((lengths <= 3).mean())
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    out[:] = [
        np.log1p(n), lengths.mean(), lengths.std(), kinds[0], kinds[1], kinds[2], kinds[4], kinds[5],
        np.log1p(odd / n), np.log1p(distinct) / np.log1p(n), top / n, pairs / max(1, n - 1), short,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), np.log1p(100 * stops / n),
        (text.count("|") + text.count("#")) / n, text.count("!") / n,
    ]
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, the standardised statistics and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.freq + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.lift(stats) @ self.weights, self.knots, self.levels)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the blocks' mean raw scores."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([t, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 12_000, features: int = 256, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Learn from labels (id, 0 or 1; nulls are left out) and the texts of docs with those ids.

    Without a label of either kind the score is the share of ones, or 0.5 with no label at all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("double").alias("y")).where("__id is not null and y is not null")
    picked = known.orderBy(F.xxhash64("__id"), "__id", "y").limit(sample_rows)
    # at most sample_rows pairs of numbers, so the broadcast has a bound
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "__id")

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf.h, "y": pdf.y, "x": [statistics(t) for t in pdf.text]})

    rows = joined.select(F.xxhash64(F.lit(seed), "__id").alias("h"), "y", "text").mapInPandas(measure, "h long, y double, x array<double>")
    rows = materialize(rows.repartition(_PARTS), "quality")

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, ones, few = 0, np.zeros(N_STATS), np.zeros(N_STATS), 0.0, []
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.x)
                n, s, q, ones = n + len(x), s + x.sum(0), q + (x * x).sum(0), ones + pdf.y.sum()
                few = [*few, *pdf.sort_values("h").x.head(64)][:64]
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q], "ones": [ones], "few": [np.concatenate(few) if few else np.zeros(0)]})

    m = rows.coalesce(_PARTS).sortWithinPartitions("h", "y").mapInPandas(moments, "n long, s array<double>, q array<double>, ones double, few array<double>").toPandas()
    n, ones = int(m.n.sum()), float(m.ones.sum())
    mean = np.sum(np.stack(m.s), axis=0) / max(1, n)
    scale = np.sqrt(np.maximum(np.sum(np.stack(m.q), axis=0) / max(1, n) - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    flat = QualityModel(mean, scale, np.zeros((N_STATS, 1)), np.zeros(1), np.zeros(N_STATS + 2), np.array([0.0]), np.array([ones / n if n else 0.5]))
    if not 0 < ones < n:
        release(rows)
        return flat
    few = np.clip((np.concatenate([np.reshape(f, (-1, N_STATS)) for f in m.few]) - mean) / scale, -6, 6)
    gaps = np.sqrt(((few[:, None] - few[None]) ** 2).sum(-1))
    width = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 1.0
    model = QualityModel(mean, scale, rng.normal(size=(N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + N_STATS + 1), flat.knots, flat.levels)
    d = features + N_STATS + 1

    def normal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, k = np.zeros((d, d)), np.zeros(d), 0
        for pdf in batches:
            if len(pdf):
                z = model.lift(np.stack(pdf.x))
                a, b, k = a + z.T @ z, b + z.T @ pdf.y.to_numpy(), k + len(z)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "k": [k]})

    fitting = rows.where(F.abs(F.col("h")) % 4 != 0).coalesce(_PARTS).sortWithinPartitions("h", "y")
    parts = fitting.mapInPandas(normal, "a binary, b binary, k long").toPandas()
    a = sum(np.frombuffer(x).reshape(d, d) for x in parts.a)
    b = sum(np.frombuffer(x) for x in parts.b)
    model.weights = np.linalg.solve(a + ridge * max(1, int(parts.k.sum())) / 100 * np.eye(d), b)

    def raw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"r": model.lift(np.stack(pdf.x)) @ model.weights, "y": pdf.y})

    held = rows.where(F.abs(F.col("h")) % 4 == 0).mapInPandas(raw, "r double, y double").toPandas().sort_values(["r", "y"])
    if len(held) < 20 or held.y.nunique() < 2:
        held = rows.mapInPandas(raw, "r double, y double").toPandas().sort_values(["r", "y"])
    release(rows)
    model.knots, model.levels = isotonic(held.r.to_numpy(), held.y.to_numpy())
    return model


def score(df: DataFrame, model: QualityModel, text_col: str = "text") -> Column:
    """The calibrated score of each whole text, 0 to 1; null and empty texts are scored alike, from zero statistics."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.stack([statistics(t) for t in text])))

    return of(F.col(f"`{text_col}`"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs whose score is at least threshold, with the columns of docs."""
    model = fit(docs, labels, **options)
    return docs.withColumn("__score", score(docs, model)).where(F.col("__score") >= threshold).drop("__score")
