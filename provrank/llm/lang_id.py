"""Language ID by nearest centroid: hashed character bi- and trigrams, TF-IDF, several centroids a language, cosine.

Document frequencies cover every training row. The centroids are clustered on at most
``sample_rows`` of them (a documented bound), an equal share for each language, taken by a hash of
the id. A text whose best cosine is under ``min_similarity`` is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.llm._common import add_columns, materialize, release, small_batches

DIM = 4096
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The code point where it is a letter, else a space."""
    t = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if chr(i).isalpha():
            t[i] = i
    return t


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of the n-grams of the whole text; None without a letter."""
    cp = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not (cp != 32).any():
        return None
    with np.errstate(over="ignore"):
        two = cp[:-1] * np.uint32(2654435761) + cp[1:] * np.uint32(40503)
        three = two[:-1] * np.uint32(2246822519) + cp[2:] * np.uint32(3266489917)
        keys = np.concatenate([two, three]) * np.uint32(668265263)
    return np.bincount(keys >> np.uint32(32 - 12), minlength=DIM).astype(np.float32)


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most k unit centroids."""
    c = x.mean(axis=0, keepdims=True)
    picked = [int(np.argmax(x @ c[0]))]
    while len(picked) < min(k, len(x)):
        far = (x @ x[picked].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        picked.append(int(np.argmin(far)))
    c = x[picked]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    min_similarity: float

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, bool]]:
        rows = [None if t is None else counts(t) for t in texts]
        out = [(UNKNOWN, 0.0, True)] * len(rows)
        have = [i for i, r in enumerate(rows) if r is not None]
        if have and self.langs:
            sim = weigh(np.stack([rows[i] for i in have]), self.idf) @ self.centroids.T
            for i, s in zip(have, sim, strict=True):
                j = int(np.argmax(s))
                out[i] = (self.langs[j], float(min(1.0, max(0.0, s[j]))), bool(s[j] < self.min_similarity))
        return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", clusters: int = 3, sample_rows: int = 1600, min_similarity: float | None = None) -> LanguageModel:
    """Learn from the rows of train with a text and a language. Without any, every prediction is ``und``."""
    spark = train.sparkSession
    small_batches(spark)
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).where("text is not null and lang is not null")
    # a row for each language, as the model itself has
    n_of = {r.lang: r.n for r in train.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    each = max(8, sample_rows // max(1, len(n_of)))
    # a share of the hash range of about twice what is wanted; row_number() then sets the bound
    top = F.lit(0.0)
    if n_of:
        top = F.create_map(*[F.lit(x) for lang, n in sorted(n_of.items()) for x in (lang, 2.0 * each / n * 2.0**63)])[F.col("lang")]
    tagged = rows.withColumn("pick", F.coalesce(F.abs(F.col("h").cast("double")) < top, F.lit(False)))

    def gather(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for pdf in batches:
            kept = []
            for text, lang, h, pick in zip(pdf.text, pdf.lang, pdf.h, pdf.pick, strict=True):
                c = counts(text)
                if c is None:
                    continue
                df += c > 0
                n += 1
                if pick:
                    kept.append((lang, h, c.tobytes(), -1, 0))
            if kept:
                yield pd.DataFrame(kept, columns=["lang", "h", "vec", "slot", "n"])
        yield pd.DataFrame({"lang": None, "h": 0, "vec": None, "slot": np.arange(DIM + 1), "n": np.append(df, n)})

    seen = materialize(tagged.mapInPandas(gather, "lang string, h long, vec binary, slot int, n long"), "langid")
    total = np.zeros(DIM + 1)
    for r in seen.where("slot >= 0").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[r.slot] = r.n
    idf = np.log((1 + total[DIM]) / (1 + total[:DIM])).astype(np.float32)
    w = Window.partitionBy("lang").orderBy("h", "vec")
    picked = seen.where("slot < 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each).select("lang", "vec").toPandas()
    release(seen)
    cents, langs, own = [], [], []
    for lang, part in sorted(picked.groupby("lang"), key=lambda x: x[0]):
        x = weigh(np.stack([np.frombuffer(v, dtype=np.float32) for v in part.vec]), idf)
        c = cluster(x, clusters)
        own.append((x @ c.T).max(axis=1))
        cents.append(c)
        langs += [lang] * len(c)
    floor = min_similarity if min_similarity is not None else (0.5 * float(np.quantile(np.concatenate(own), 0.01)) if own else 0.0)
    return LanguageModel(idf, np.concatenate(cents) if cents else np.zeros((0, DIM), np.float32), langs, floor)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    A null text, and one without a letter, gets ``und``, 0 and rejected. Repeated rows get equal
    results. Columns of df with those names give way.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(text), columns=["lang_pred", "score", "rejected"])

    out = df.withColumn("__lang", predict(F.col(f"`{text_col}`")))
    return add_columns(out, {c: F.col(f"__lang.{c}") for c in ("lang_pred", "score", "rejected")}).drop("__lang")


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % mod, F.lit(-1))
