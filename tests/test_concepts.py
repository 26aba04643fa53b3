"""Keyphrases: what a text's own statistics prefer, and a walk that ends only with the ranking."""

import random
import unicodedata

import pandas as pd

from provrank.operators import concepts

TEXT = "Citation graphs link papers. A Citation graph shows how papers cite. Random walks on citation graphs rank papers. It is of no use to walk at random. The weather was fine on that day."


def plain_walk(text, top, alike):
    kept = []
    for score, phrase in concepts.phrase_scores(text):
        if all(concepts.similarity(phrase, k) <= alike for k, _ in kept):
            kept.append((phrase, score))
    return kept[:top]


def test_words_that_matter_come_first():
    found = [p for p, _ in concepts.text_keyphrases(TEXT)]
    assert len(found) == 8 and set(found[:3]) == {"citation", "papers", "graphs"} and "citation graphs" in found and not {"weather", "fine", "was"} & set(found)
    scores = concepts.term_scores([["the", "fixed", "term"], ["one", "loose", "word"], ["the", "fixed", "term"], ["two", "loose", "ends"], ["some", "Name", "and", "some", "name"]])
    assert scores["fixed"] < scores["loose"]  # always beside the same words
    assert not any(p.split()[0] in ("it", "is", "of", "no", "to", "a") for _, p in concepts.phrase_scores(TEXT))


def test_similar_phrases_are_passed_over_down_the_whole_ranking():
    rng = random.Random(3)
    many = " ".join(f"abcdefghijklmnopqrst{c}" for c in "abcdefghijklmnopqrstuvwxyz") + ". " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) for _ in range(30)) + "."
    for text in (TEXT, many, "same same same same same same. " * 9, "x " * 30, "12 345 6789 " * 5):
        for alike in (0.5, 0.85, 1.0):
            assert concepts.text_keyphrases(text, alike=alike) == plain_walk(text, 8, alike)
    kept = [p for p, _ in concepts.text_keyphrases(many)]
    assert len(kept) == 8  # though the 26 words that are alike outnumber three times eight
    assert all(concepts.similarity(a, b) <= 0.85 for i, a in enumerate(kept) for b in kept[:i])


def test_similarity_is_an_edit_distance():
    assert concepts.similarity("kitten", "sitting") == 1 - 3 / 7 and concepts.similarity("", "") == 1 and concepts.similarity("a", "") == 0
    assert concepts.similarity("abc", "abc") == 1 and concepts.similarity("flaw", "lawn") == 0.5


def test_keyphrases_of_papers(spark):
    rows = [("a", TEXT), ("b", "too short"), ("c", None), ("d", "!!! ??? ... --- ___ ###"), ("e", unicodedata.normalize("NFC", "Größere Übung über Ähnlichkeit. Übung macht Größere froh.")), ("f", "word " * 20_000)]
    got = concepts.keyphrases(spark.createDataFrame(rows, "paper_id string, abstract string").repartition(2)).toPandas()
    assert set(got.paper_id) == {"a", "e", "f"} and got.groupby("paper_id").size().max() <= 8
    want = [(p, 1 / (1 + s)) for p, s in concepts.text_keyphrases(TEXT)]
    own = got[got.paper_id == "a"]
    assert sorted(zip(own.phrase, own.weight, strict=True)) == sorted(want) and own.weight.between(0, 1).all()
    assert "übung" in set(got[got.paper_id == "e"].phrase)


def test_whole_table(spark, small):
    from provrank.plans.queries import QUERIES

    got = QUERIES["keyphrases"](spark, small).toPandas()
    docs = pd.read_parquet(f"{small}/documents.parquet")
    want = {(str(i), p) for i, t in zip(docs.doc_id, docs.text, strict=True) if t and len(t) >= 20 for p, _ in concepts.text_keyphrases(t)}
    assert set(zip(got.paper_id, got.phrase, strict=True)) == want and got.paper_id.nunique() > 100
