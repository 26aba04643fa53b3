"""Ranking papers: BM25, dense cosine, reciprocal-rank fusion, min-max weighting with PageRank, attribution of the top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.functions.stats import min_max, steady_sum
from provrank.functions.text import document_text, tokens
from provrank.operators import flow as flow_ops
from provrank.storage import materialize

SIGNALS = ("bm25-only", "dense-only", "rrf-only", "rrf+ppr")
#: Scores are rounded to this many decimals before ranking, as summation order differs from run to run.
DECIMALS = 12
#: BM25 sums reach hundreds, where a double has fewer decimals to spare.
SIGNAL_DECIMALS = 9


def bm25(papers: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(paper_id, bm25) of every paper for a query text; repeated query words count again, a query without words scores 0.

    idf = ln(N - n + 0.5) - ln(n + 0.5); a negative idf becomes a quarter of the mean idf over all terms.
    Only counts by term leave the scan: document frequencies are aggregated before the shuffle. Papers with equal
    words have equal scores.
    """
    spark = papers.sparkSession
    text = document_text(F.col("title"), F.col("abstract"))
    words = papers.select("paper_id", tokens(text).alias("words"))
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg")).first()
    if not size.n or not size.avg:
        return papers.select("paper_id", F.lit(0.0).alias("bm25"))
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    idf = materialize(df.withColumn("idf", F.ln(F.lit(float(size.n)) - F.col("n") + 0.5) - F.ln(F.col("n") + 0.5)).select("term", "idf"), "idf")
    floor = 0.25 * (idf.agg(F.avg("idf")).first()[0] or 0.0)
    # as many rows as the query text has distinct words
    wanted = materialize(idf.join(asked, "term").select("term", "times", F.when(F.col("idf") < 0, F.lit(floor)).otherwise(F.col("idf")).alias("idf")), "query")
    tf = words.select("paper_id", F.size("words").alias("len"), F.explode("words").alias("term")).join(wanted.select("term"), "term", "left_semi").groupBy("paper_id", "term", "len").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / size.avg))
    scored = tf.join(wanted, "term").groupBy("paper_id").agg(steady_sum(part).alias("s"))
    return papers.select("paper_id").join(scored, "paper_id", "left").select("paper_id", F.coalesce("s", F.lit(0.0)).alias("bm25"))


def dense(papers: DataFrame, vectors: DataFrame, query_vector: list[float] | None) -> DataFrame:
    """(paper_id, dense): dot product with the query's vector in double; 0 for a paper without a vector."""
    if query_vector is None:
        return papers.select("paper_id", F.lit(0.0).alias("dense"))
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    dot = F.aggregate(F.zip_with(F.col("vector").cast("array<double>"), q, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return papers.select("paper_id").join(vectors.select("paper_id", dot.alias("d")), "paper_id", "left").select("paper_id", F.coalesce("d", F.lit(0.0)).alias("dense"))


def positions(df: DataFrame, score: str, name: str, ascending_ties: str = "paper_id", decimals: int = DECIMALS) -> DataFrame:
    """df with name, the 1-based position by score descending; ties by id.

    One total order over a corpus is sorted by range, numbered within each range and offset by the
    ranges' counts, so no task holds all rows.
    """
    keyed = df.withColumn("__s", -F.round(F.col(score), decimals))
    ordered = materialize(keyed.repartitionByRange("__s", ascending_ties).sortWithinPartitions("__s", ascending_ties).withColumn("__part", F.spark_partition_id()), "ordered")
    rn = F.row_number().over(Window.partitionBy("__part").orderBy("__s", ascending_ties))
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row for each range: as many as there are shuffle partitions
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ordered.withColumn("__rn", rn).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__rn")).cast("long")).drop("__s", "__part", "__n", "__rn", "__before")


def rrf(scored: DataFrame, columns: list[str], k: int = 60) -> DataFrame:
    """scored with a position for each score column and rrf, the sum of 1 / (k + position)."""
    out = scored
    for c in columns:
        out = positions(out, c, f"{c}_rank", decimals=SIGNAL_DECIMALS)
    total = F.lit(0.0)
    for c in columns:
        total = total + 1.0 / (k + F.col(f"{c}_rank"))
    return out.withColumn("rrf", total)


@dataclass(frozen=True)
class Result:
    """candidates (paper_id, position, score, rrf, ppr, ...), contributions of the top, and the flow they come from."""

    candidates: DataFrame
    contributions: DataFrame | None
    flow: flow_ops.Flow | None


def normal(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with min-max of a column over all its rows, from one aggregate row."""
    r = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = r.low or 0.0, r.high or 0.0
    return df.withColumn(name, F.lit(0.0) if high - low < 1e-15 else (F.col(column) - low) / (high - low))


def search(papers: DataFrame, nodes: DataFrame, arcs: DataFrame, query: str, vectors: DataFrame | None = None, signals: str = "rrf+ppr", top_k: int = 20, pool_size: int = 200, w_rrf: float = 0.6, w_ppr: float = 0.4, rrf_k: int = 60, attribute: bool = True, compat_dense_zero: bool = False, query_vector: list[float] | None = None, **ppr_options) -> Result:
    """Rank papers for a paper id, or else a free text.

    A paper's own text is its query and it is never ranked. Without vectors the dense signal is left out of the
    fusion, unless compat_dense_zero gives every paper 0 there. An unknown signal is an error.
    """
    if signals not in SIGNALS:
        raise ValueError(f"unknown signals {signals!r}; one of {SIGNALS}")
    seed = papers.where(F.col("paper_id") == query).select("paper_id", document_text(F.col("title"), F.col("abstract")).alias("t")).first()
    if vectors is not None and query_vector is None and seed:
        row = vectors.where(F.col("paper_id") == query).first()
        query_vector = list(row.vector) if row else None
    scored = bm25(papers, seed.t if seed else query)
    use_dense = vectors is not None or compat_dense_zero
    if use_dense:
        scored = scored.join(dense(papers, vectors if vectors is not None else papers.select("paper_id", F.array(F.lit(0.0)).alias("vector")), query_vector if vectors is not None else None), "paper_id")
    columns = {"bm25-only": ["bm25"], "dense-only": ["dense"]}.get(signals, ["bm25", "dense"] if use_dense else ["bm25"])
    if "dense" in columns and not use_dense:
        raise ValueError("dense-only needs vectors")
    scored = materialize(rrf(materialize(scored, "scores"), columns, rrf_k), "fused")
    flow = None
    if signals == "rrf+ppr":
        best = [F.round("rrf", DECIMALS).desc(), "paper_id"]
        seeds = papers.where(F.col("paper_id") == query).select(F.col("paper_id").alias("node_id")) if seed else scored.orderBy(*best).limit(5).select(F.col("paper_id").alias("node_id"), F.col("rrf").alias("weight"))
        flow = flow_ops.rank(arcs, flow_ops.personalization(nodes, seeds), **ppr_options)
        scored = scored.join(flow.scores.select(F.col("node_id").alias("paper_id"), "x"), "paper_id", "left").withColumn("ppr", F.coalesce("x", F.lit(0.0))).drop("x")
    else:
        scored = scored.withColumn("ppr", F.lit(0.0))
    scored = materialize(scored, "scored")
    weight = (lambda r, p: F.round(w_rrf * F.col(r) + w_ppr * F.col(p), DECIMALS)) if signals == "rrf+ppr" else (lambda r, p: F.round(F.col(r), DECIMALS))
    wide = normal(normal(scored, "rrf", "__r"), "ppr", "__p").withColumn("__w", weight("__r", "__p"))
    pool = wide.where(F.col("paper_id") != query).orderBy(F.desc("__w"), "paper_id").limit(pool_size).drop("__r", "__p", "__w")
    pool = materialize(pool, "pool")
    every = Window.partitionBy(F.lit(0))  # at most pool_size rows
    pool = pool.withColumn("rrf_norm", min_max(F.col("rrf"), every)).withColumn("ppr_norm", min_max(F.col("ppr"), every)).withColumn("score", weight("rrf_norm", "ppr_norm"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "paper_id")
    top = materialize(pool.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_k), "top")
    found = flow_ops.attribute(flow, top.select(F.col("paper_id").alias("node_id"))) if attribute and flow else None
    return Result(top, found, flow)


def citation_relevance(arcs: DataFrame, seed: str) -> DataFrame:
    """(paper_id, relevance) around a seed: 2 for what it cites, 1 for what cites it, the larger of both."""
    rel = F.when(F.col("rel") == "cites", 2.0).otherwise(1.0)
    return arcs.where((F.col("src") == seed) & F.col("rel").isin("cites", "cited_by") & (F.col("dst") != seed)).groupBy(F.col("dst").alias("paper_id")).agg(F.max(rel).alias("relevance"))


def evaluation_seeds(papers: DataFrame, given: DataFrame | None = None, count: int = 10) -> DataFrame:
    """Seeds given by id that are papers; else those at hop 0 where hops are known; else the most cited."""
    if given is not None:
        return papers.join(given.select("paper_id"), "paper_id", "left_semi").select("paper_id")
    if "hop" in papers.columns and not papers.where("hop = 0").isEmpty():
        return papers.where("hop = 0").select("paper_id")
    return papers.orderBy(F.desc("citation_count"), "paper_id").limit(count).select("paper_id")
