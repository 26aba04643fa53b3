"""Explainers of (seed, candidate) pairs. The deterministic one is a DataFrame plan; model-backed ones call a driver-side client.

Without a client the model-backed explainers are skipped with a warning, never replaced by the deterministic one.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.functions.text import parse_json_object
from provrank.operators import metapaths

log = logging.getLogger(__name__)
Model = Callable[[str], str]


@dataclass
class CachedModel:
    """Calls models in order until one answers; answers are kept by the first model's name and the prompt."""

    models: dict[str, Model]
    cache: dict[str, str] = field(default_factory=dict)

    def complete(self, prompt: str) -> str:
        key = hashlib.sha256(f"{next(iter(self.models))}\x1f{prompt}".encode()).hexdigest()
        if key not in self.cache:
            errors = []
            for name, call in self.models.items():
                try:
                    self.cache[key] = call(prompt)
                    break
                except Exception as e:  # the next model may answer
                    errors.append(f"{name}: {e}")
            else:
                raise RuntimeError("no model answered: " + "; ".join(errors))
        return self.cache[key]


def grounded_prompt(seed: str, candidate: str, facts: list[str]) -> str:
    listed = "\n".join(f"{i}. {f}" for i, f in enumerate(facts, 1))
    return f"Seed: {seed}\nCandidate: {candidate}\nFacts:\n{listed}\nIn two sentences, and from these facts only, say why the candidate matters to the seed. Reply as JSON with explanation and fact_numbers."


def free_prompt(papers: DataFrame, pairs: DataFrame, limit: int = 2500) -> DataFrame:
    """(seed, candidate, prompt) from titles and abstracts alone: no fact of the graph enters."""
    p = papers.select("paper_id", "title", F.substring(F.coalesce("abstract", F.lit("")), 1, limit).alias("abstract"))
    side = lambda c: p.select(F.col("paper_id").alias(c), F.col("title").alias(f"{c}_title"), F.col("abstract").alias(f"{c}_abstract"))
    both = pairs.join(side("seed"), "seed").join(side("candidate"), "candidate")
    tail = "Explain the relevance in two sentences as JSON with explanation and relationships (relation, detail); relation is one of " + ", ".join(metapaths.TYPES) + "."
    return both.select("seed", "candidate", F.concat_ws("\n", F.lit("Seed"), "seed_title", "seed_abstract", F.lit("Candidate"), "candidate_title", "candidate_abstract", F.lit(tail)).alias("prompt"))


def deterministic(pairs: DataFrame, arcs: DataFrame, nodes: DataFrame, max_paths: int = 12) -> DataFrame:
    found = metapaths.paths(pairs, arcs, nodes, max_paths)
    return metapaths.explain(pairs, found).withColumn("explainer", F.lit("metapath"))


def grounded(pairs: DataFrame, found: DataFrame, client: CachedModel) -> DataFrame:
    """Cells of the model that sees numbered facts; a pair without a path asks nothing, an unreadable reply cites nothing."""
    spark = pairs.sparkSession
    listed = found.groupBy("seed", "candidate").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("["), "relation", F.lit("] "), "detail").alias("fact")))).alias("facts"))
    replies = []
    for r in listed.orderBy("seed", "candidate").collect():  # the pairs of one explanation run, a top list
        answer = client.complete(grounded_prompt(r.seed, r.candidate, [f.fact for f in r.facts]))
        parsed = parse_json_object(answer)
        numbers = [str(x) for x in (parsed or {}).get("fact_numbers") or []]
        replies.append((r.seed, r.candidate, str((parsed or {}).get("explanation") or answer).strip(), numbers, parsed is not None))
    said = spark.createDataFrame(replies, "seed string, candidate string, text string, fact_numbers array<string>, parse_ok boolean")
    cited = metapaths.ground_facts(said, found)
    none = F.lit("The graph holds no typed path for this pair.")
    out = pairs.select("seed", "candidate").distinct().join(said.drop("fact_numbers"), ["seed", "candidate"], "left").join(cited, ["seed", "candidate"], "left")
    return out.select("seed", "candidate", F.coalesce("text", none).alias("text"), F.coalesce("cited_edges", F.array().cast("array<string>")).alias("cited_edges"), "parse_ok", "facts_used", "out_of_range", "unparseable", F.lit("llm-grounded").alias("explainer"))


def free(pairs: DataFrame, papers: DataFrame, found: DataFrame, client: CachedModel) -> DataFrame:
    """Cells of the model that sees no graph; its claims are grounded by type afterwards."""
    spark = pairs.sparkSession
    claims, texts = [], []
    for r in free_prompt(papers, pairs).orderBy("seed", "candidate").collect():  # a top list
        parsed = parse_json_object(client.complete(r.prompt)) or {}
        texts.append((r.seed, r.candidate, str(parsed.get("explanation") or "")))
        for i, c in enumerate(parsed.get("relationships") or [], 1):
            claims.append((r.seed, r.candidate, i, str(c.get("relation")) if isinstance(c, dict) else str(c)))
    said = spark.createDataFrame(texts, "seed string, candidate string, text string")
    rows = metapaths.ground_claims(spark.createDataFrame(claims, "seed string, candidate string, claim_no int, relation string"), found)
    edges = rows.groupBy("seed", "candidate").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "edge_ids"))), lambda x: x["edge_ids"]))).alias("cited_edges"), F.sum(F.col("reason").isNotNull().cast("int")).alias("unrealised_claims"))
    out = said.join(edges, ["seed", "candidate"], "left")
    return out.select("seed", "candidate", "text", F.coalesce("cited_edges", F.array().cast("array<string>")).alias("cited_edges"), F.coalesce("unrealised_claims", F.lit(0)).alias("unrealised_claims"), F.lit("llm-free").alias("explainer"))


def available(names: list[str], client: CachedModel | None) -> tuple[list[str], list[str]]:
    """Names that can run and names skipped; an unknown name is an error."""
    known = ("metapath", "llm-grounded", "llm-free")
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown explainer {bad[0]!r}")
    skipped = [n for n in names if n.startswith("llm-") and client is None]
    for n in skipped:
        log.warning("%s needs a model client and is skipped", n)
    return [n for n in names if n not in skipped], skipped
