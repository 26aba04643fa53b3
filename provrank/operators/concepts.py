"""Concepts of papers: field labels and keyphrases shared by two papers or more.

The default keyphrase scorer judges a text by itself: a word by how often, where, how written and beside what it
stands, a phrase by its words, near-repeats left out. It follows the published idea of local statistics but not
one extractor's figures; pass another one to replace it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop
from math import log
from statistics import fmean, pstdev

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SENTENCE = re.compile(r"[.!?\n\r]+")
_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: Shorter words hold phrases together but say nothing by themselves.
_SHORT = 3


@dataclass(slots=True)
class _Term:
    """What one text says about a word: how often, how written, in which sentences, beside what."""

    name: str = ""
    count: int = 0
    capital: int = 0
    upper: int = 0
    sentences: list[int] = field(default_factory=list)
    left: set[str] = field(default_factory=set)
    n_left: int = 0
    right: set[str] = field(default_factory=set)
    n_right: int = 0


def _informs(word: str) -> bool:
    return len(word) >= _SHORT and not word.isdigit()


def _terms(sentences: list[list[str]], lowered: list[list[str]]) -> dict[str, _Term]:
    found: dict[str, _Term] = {}
    for k, (words, low) in enumerate(zip(sentences, lowered, strict=True)):
        before = None
        for w, name in zip(words, low, strict=True):
            t = found.get(name)
            if t is None:
                t = found[name] = _Term()
            t.count += 1
            if w is not name and w != name:
                if len(w) > 1 and w.isupper():
                    t.upper += 1
                if before is not None and w[0].isupper():
                    t.capital += 1
            if not t.sentences or t.sentences[-1] != k:
                t.sentences.append(k)
            if before is not None:
                t.left.add(before.name)
                t.n_left += 1
                before.right.add(name)
                before.n_right += 1
            t.name = name
            before = t
    return found


def _scores(terms: dict[str, _Term], n_sentences: int) -> dict[str, float]:
    counts = [t.count for w, t in terms.items() if _informs(w)]
    if not counts:
        return {}
    usual, most = fmean(counts) + pstdev(counts), max(t.count for t in terms.values())
    out = {}
    for w, t in terms.items():
        spread = (len(t.left) / t.n_left if t.n_left else 0) + (len(t.right) / t.n_right if t.n_right else 0)  # 1 for each side that never repeats
        bond = 1 + spread * t.count / most
        seen = t.sentences
        middle = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2
        case = max(t.capital, t.upper) / (1 + log(t.count))
        out[w] = bond * log(log(3 + middle) + 1) / (case + (t.count / usual + len(seen) / n_sentences) / bond)
    return out


def term_scores(sentences: list[list[str]]) -> dict[str, float]:
    """A score for each word of a text, low where it matters: often, early, in many sentences, capitalised, beside few other words."""
    return _scores(_terms(sentences, [[w.lower() for w in words] for words in sentences]), len(sentences))


def _phrases(text: str, max_n: int, min_phrase: int) -> list[tuple[float, str]]:
    sentences = [words for s in _SENTENCE.split(text) if (words := _TERM.findall(s))]
    lowered = [[w.lower() for w in words] for words in sentences]
    scores = _scores(_terms(sentences, lowered), len(sentences))
    good = {w for w in scores if _informs(w)}
    seen: dict[str, int] = {}
    for low in lowered:
        ok = [w in good for w in low]
        for i, w in enumerate(low):
            if ok[i]:
                seen[w] = seen.get(w, 0) + 1
                for j in range(i + 1, min(i + max_n, len(low))):
                    if ok[j]:
                        phrase = " ".join(low[i : j + 1])
                        seen[phrase] = seen.get(phrase, 0) + 1
    ranked = []
    for phrase, count in seen.items():
        if len(phrase) >= min_phrase:
            total, product = 1.0, 1.0
            for w in phrase.split(" "):
                if w in good:
                    total += scores[w]
                    product *= scores[w]
            ranked.append((product / (count * total), phrase))
    return ranked


def phrase_scores(text: str, max_n: int = 3, min_phrase: int = 3) -> list[tuple[float, str]]:
    """(score, phrase) of all phrases of a text, best first: runs of up to max_n words of a sentence that begin and end with a word that informs."""
    return sorted(_phrases(text, max_n, min_phrase))


def similarity(a: str, b: str) -> float:
    """1 less the edit distance in shares of the longer text."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / max(1, len(a))


def text_keyphrases(text: str, top: int = 8, max_n: int = 3, min_phrase: int = 3, alike: float = 0.85) -> list[tuple[str, float]]:
    """The top phrases and their scores; a phrase that is alike to a better one is passed over, down the whole ranking."""
    kept: list[tuple[str, float]] = []
    ranked = _phrases(text, max_n, min_phrase)
    heapify(ranked)
    while ranked and len(kept) < top:
        score, phrase = heappop(ranked)
        near = (k for k, _ in kept if min(len(k), len(phrase)) > alike * max(len(k), len(phrase)))
        if not any(similarity(phrase, k) > alike for k in near):
            kept.append((phrase, score))
    return kept


def keyphrases(papers: DataFrame, top: int = 8, max_n: int = 3, min_text: int = 20, min_phrase: int = 3, alike: float = 0.85) -> DataFrame:
    """(paper_id, phrase, weight): the top phrases of each abstract of min_text characters or more; weight is 1 / (1 + score).

    A text is judged by itself, so nothing is shuffled.
    """

    def batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, 1 / (1 + s)) for p, t in zip(pdf.paper_id, pdf.abstract, strict=True) for k, s in text_keyphrases(t, top, max_n, min_phrase, alike)]
            yield pd.DataFrame(rows, columns=["paper_id", "phrase", "weight"])

    long_enough = papers.where(F.length("abstract") >= min_text).select(F.col("paper_id").cast("string").alias("paper_id"), "abstract")
    return long_enough.mapInPandas(batch, "paper_id string, phrase string, weight double")


def concept_edges(fields: DataFrame, phrases: DataFrame, slug: Callable[[Column], Column], min_papers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Edges (paper_id, concept, weight, origins) and nodes (concept, degree) of the concepts on min_papers papers or more.

    fields (paper_id, field) weigh 1; phrases (paper_id, phrase, weight) their own weight. The greatest weight of a pair counts.
    """
    a = fields.select("paper_id", F.col("field").alias("name"), F.lit(1.0).alias("weight"), F.lit("s2_field").alias("origin"))
    b = phrases.select("paper_id", F.col("phrase").alias("name"), "weight", F.lit("keyphrase").alias("origin"))
    rows = a.unionByName(b).where("name is not null").withColumn("concept", F.concat(F.lit("concept:"), slug(F.col("name")))).where("concept != 'concept:'")
    pairs = rows.groupBy("paper_id", "concept").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("origin")).alias("origins"))
    degree = pairs.groupBy("concept").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_papers)
    return pairs.join(degree.select("concept"), "concept", "left_semi"), degree


def dropped_singletons(fields: DataFrame, phrases: DataFrame, slug: Callable[[Column], Column]) -> DataFrame:
    """One row: how many concepts only one paper holds."""
    names = fields.select("paper_id", F.col("field").alias("name")).unionByName(phrases.select("paper_id", F.col("phrase").alias("name")))
    per = names.where("name is not null").groupBy(slug(F.col("name")).alias("c")).agg(F.countDistinct("paper_id").alias("n"))
    return per.agg(F.sum((F.col("n") == 1).cast("int")).alias("singletons"), F.sum((F.col("n") >= 2).cast("int")).alias("kept"))


def external_keyphrases(extract: Callable[[str], list[tuple[str, float]]]) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a function text -> [(phrase, score)], low scores best: weight 1 / (1 + score). Runs in Arrow batches."""

    def run(papers: DataFrame) -> DataFrame:
        def batch(batches):
            for pdf in batches:
                rows = [(p, k, 1 / (1 + s)) for p, t in zip(pdf.paper_id, pdf.abstract, strict=True) if t and len(t) >= 20 for k, s in extract(t) if len(k) >= 3]
                yield pd.DataFrame(rows, columns=["paper_id", "phrase", "weight"])

        return papers.select("paper_id", "abstract").mapInPandas(batch, "paper_id string, phrase string, weight double")

    return run
