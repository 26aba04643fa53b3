"""Rank metrics and statistics. Resampling takes its random numbers from sha1 of (seed, sample, position), not from a generator's state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha1

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Signs that one digest gives: its hexadecimal digits.
SIGNS = 40
#: Decimals at which means of flips are compared.
PLACES = 10
#: Differences up to this count as none.
NO_DIFFERENCE = 1e-8
#: Values that a resampling sends to every task; more are shuffled.
BROADCAST_ROWS = 1_000_000


def steady_sum(value: Column) -> Column:
    """The sum of doubles, added as decimals of 18 places, so that it does not depend on the order in which rows meet."""
    return F.sum(value.cast("decimal(28,18)")).cast("double")


def gain(relevance: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(position + 1.0)


def ndcg(ranked: DataFrame, k: int, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """(by, ndcg) from rows with by, position and relevance (all judged rows; position null where unranked); 0 where nothing is relevant."""
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance")))
    rows = ranked.withColumn("ideal", ideal)
    got = F.sum(F.when(F.col("position") <= k, gain(F.col("relevance"), F.col("position"))).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal") <= k, gain(F.col("relevance"), F.col("ideal"))).otherwise(0.0))
    return rows.groupBy(*by).agg(got.alias("dcg"), best.alias("idcg")).select(*by, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(ranked: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    first = F.min(F.when(F.col("relevance") > 0, F.col("position")))
    return ranked.groupBy(*by).agg(first.alias("first")).select(*by, F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def mean_reciprocal_rank(ranked: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    return reciprocal_rank(ranked, by).agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def min_max(value: Column, over: Window) -> Column:
    """(value - min) / (max - min) over the window; 0 where the range is under 1e-15."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low < 1e-15, F.lit(0.0)).otherwise((value - low) / (high - low))


def necessity(before: Column, after: Column, size: Column) -> Column:
    return F.when(size - before <= 0, F.lit(0.0)).otherwise((after - before) / (size - before).cast("double"))


def retention(before: Column, alone: Column, size: Column) -> Column:
    return F.when(size - before <= 0, F.lit(1.0)).otherwise(1.0 - (alone - before) / (size - before).cast("double"))


def monte_carlo_p(observed: Column, control: Column) -> Column:
    """One-sided, as an aggregate: (controls at or above observed + 1) / (controls + 1)."""
    return (F.sum(F.when(control >= observed, 1).otherwise(0)) + 1) / (F.count(control) + 1.0)


def draw(seed: int, sample: int, position: int, n: int) -> int:
    """The index that a resample draws at a position: a number below n from sha1, the same in every engine and however the work is split."""
    return int(sha1(f"{seed}:{sample}:{position}".encode()).hexdigest()[:13], 16) % n


def sign(seed: int, flip: int, position: int) -> int:
    """The sign that a flip gives a position: a digit of sha1 for each of SIGNS flips."""
    return 1 if sha1(f"{seed}:{flip // SIGNS}:{position}".encode()).hexdigest()[flip % SIGNS] < "8" else -1


def bootstrap(values: Sequence[float], samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> dict:
    """bootstrap_by() for a few values of one group, here and now; no values give zeros."""
    x = sorted(float(v) for v in values)
    n = len(x)
    if n == 0:
        return dict.fromkeys(("mean", "median", "std", "ci_low", "ci_high", "min", "max"), 0.0) | {"n": 0, "confidence": confidence}
    means = [sum(x[draw(seed, s, j, n)] for j in range(n)) / n for s in range(samples)]
    tail = (1 - confidence) / 2
    low, high = np.quantile(means, [tail, 1 - tail])
    return {"n": n, "mean": float(np.mean(x)), "median": float(np.median(x)), "std": float(np.std(x, ddof=1)) if n > 1 else 0.0, "ci_low": float(low), "ci_high": float(high), "confidence": confidence, "min": x[0], "max": x[-1]}


def paired_permutation(a: Sequence[float], b: Sequence[float], flips: int = 10_000, alpha: float = 0.05, seed: int = 42) -> dict:
    """paired_by() for a few pairs of one group, here and now; ValueError where a and b differ in length."""
    d = sorted(float(x) - float(y) for x, y in zip(a, b, strict=True))
    n = len(d)
    if max(map(abs, d), default=0.0) <= NO_DIFFERENCE:
        return {"n": n, "mean_difference": 0.0, "p_value": 1.0, "effect_size": 0.0, "significant": False}
    mean, spread = sum(d) / n, float(np.std(d, ddof=1)) if n > 1 else 0.0
    reach = sum(round(abs(sum(sign(seed, f, j) * v for j, v in enumerate(d)) / n), PLACES) >= round(abs(mean), PLACES) for f in range(flips))
    p = (reach + 1) / (flips + 1)
    return {"n": n, "mean_difference": mean, "p_value": p, "effect_size": mean / spread if spread else 0.0, "significant": p < alpha}


def _placed(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, position, n): each value's place from 0 in the ascending order of its group, without one task for a group."""
    from provrank.operators.order import numbered
    from provrank.storage import materialize, release

    all_ = numbered(rows.where(F.col(by).isNotNull() & F.col(value).isNotNull()), [by, value], "__seq")
    sizes = all_.groupBy(by).agg(F.min("__seq").alias("__first"), F.count("*").alias("n"))
    out = materialize(all_.join(sizes, by).select(by, value, (F.col("__seq") - F.col("__first")).alias("position"), "n"), "placed")
    release(all_)
    return out


def bootstrap_by(df: DataFrame, by: str, value: str, samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, n, mean, median, std, ci_low, ci_high, confidence, min, max): moments and the percentile interval of resampled means.

    Resample s draws at position j what draw() gives, so DataFrame operations make and sum the draws, a
    group's spread over tasks. std has ddof 1; one value is its own interval; null values don't count,
    a group without values has zeros, a null group is left out.
    """
    rows = df.where(F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias(value))
    placed = _placed(rows, by, value)
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.col("position").cast("string")))
    dealt = placed.select(by, "n", "position").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a small file would be one task
    drawn = dealt.select(by, "n", "position", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    drawn = drawn.select(by, "sample", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % F.col("n")).alias("position"))
    # the draws are samples times values, which no estimate of the plan shows: never the side that is kept or sent
    kept = placed.select(by, "position", value)
    kept = F.broadcast(kept) if placed.count() <= BROADCAST_ROWS else kept.hint("shuffle_hash")
    means = drawn.join(kept, [by, "position"]).groupBy(by, "sample").agg(F.avg(value).alias("mean"))
    tail = (1 - confidence) / 2
    span = means.groupBy(by).agg(F.percentile("mean", F.lit(tail)).alias("ci_low"), F.percentile("mean", F.lit(1 - tail)).alias("ci_high"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = moments(rows, by, value).join(span, by, "left")
    return out.select(by, "n", *map(zero, ("mean", "median", "std", "ci_low", "ci_high")), F.lit(confidence).alias("confidence"), zero("min"), zero("max"))


def paired_by(df: DataFrame, by: str, a: str, b: str, flips: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(by, n, mean_difference, p_value, effect_size, significant): a two-sided sign-flip test of a - b, one added above and below.

    A flip gives each difference, by its position in order, the sign() of its digest. Means are compared at
    PLACES decimals. Where no difference exceeds NO_DIFFERENCE p is 1. Pairs with a null don't count.
    """
    rows = df.select(by, (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    placed = _placed(rows, by, "d")
    blocks = -(-flips // SIGNS)

    def signed_sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the sign of a digit of the digest is its highest bit
        order = np.arange(SIGNS)
        at = order // 2 * 8 + order % 2 * 4
        for pdf in batches:
            for group, rows in pdf.groupby(by, sort=False):
                d, sums = rows.d.to_numpy(), np.zeros((blocks, SIGNS))
                for k in range(0, len(d), 64):
                    raw = b"".join(sha1(f"{seed}:{b}:{j}".encode()).digest() for j in rows.position.iloc[k : k + 64] for b in range(blocks))
                    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, blocks, 20), axis=2)[:, :, at]
                    sums += np.tensordot(d[k : k + 64], 1.0 - 2.0 * bits, axes=1)
                yield pd.DataFrame({by: [group], "sums": [sums.ravel()[:flips]]})

    kind = placed.schema[by].dataType.simpleString()
    spread = placed.select(by, "d", "position").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions(by)
    sums = spread.mapInPandas(signed_sums, f"`{by}` {kind}, sums array<double>").select(by, F.posexplode("sums").alias("flip", "s")).groupBy(by, "flip").agg(F.sum("s").alias("s"))
    size = placed.groupBy(by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("spread"), F.max(F.abs("d")).alias("most"))
    signed = sums.join(size, by).withColumn("m", F.col("s") / F.col("n"))
    reach = signed.groupBy(by).agg(F.count(F.when(F.round(F.abs("m"), PLACES) >= F.round(F.abs("mean"), PLACES), 1)).alias("reach"))
    none = F.col("most") <= NO_DIFFERENCE
    p = F.when(none, 1.0).otherwise((F.col("reach") + 1) / F.lit(flips + 1))
    out = size.join(reach, by).select(by, "n", F.when(none, 0.0).otherwise(F.col("mean")).alias("mean_difference"), p.alias("p_value"), F.when(none | (F.col("spread") == 0), 0.0).otherwise(F.col("mean") / F.col("spread")).alias("effect_size"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def moments(df: DataFrame, by: str, value: str) -> DataFrame:
    """The distribution's exact part, without resampling."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def format_distribution(mean: Column, low: Column, high: Column, n: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f] (n=%d)", mean, low, high, n)
