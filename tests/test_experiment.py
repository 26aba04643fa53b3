"""A hand-placed corpus: one candidate tied to the seed by its own edges, one only by a crowded venue."""

import pytest
from pyspark.sql import functions as F

from provrank import explainers
from provrank.functions import stats
from provrank.operators import ablation, flow, graph, metapaths, prereq, retrieval
from provrank.schema import check_vocabulary, with_edge_ids
from provrank.storage import materialize

PAPERS = ["SEED", "NEAR", "FAR", "R1", "R2", "CITER", *[f"F{i}" for i in range(8)]]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("SEED", "cites", "NEAR", 1.0), ("SEED", "cites", "R1", 1.0), ("SEED", "cites", "R2", 1.0), ("NEAR", "cites", "R1", 1.0), ("NEAR", "cites", "R2", 1.0), ("CITER", "cites", "SEED", 1.0), ("CITER", "cites", "NEAR", 1.0)]
    rows += [("SEED", "authored_by", "author:ann", 1.0), ("NEAR", "authored_by", "author:ann", 1.0)] + [(p, "authored_by", f"author:{p}", 1.0) for p in PAPERS if p != "NEAR"]
    rows += [(p, "published_in", "venue:hub" if p in ("SEED", "FAR") or p[0] == "F" else f"venue:{p}", 1.0) for p in PAPERS]
    rows += [("SEED", "shares_concept", "concept:flows", 0.9), ("NEAR", "shares_concept", "concept:flows", 0.8)] + [(p, "shares_concept", "concept:text", 0.4) for p in PAPERS if p in ("SEED", "FAR", "CITER") or p[0] == "F"]
    edges = materialize(with_edge_ids(spark.createDataFrame(sorted(set(rows)), "src string, rel string, dst string, weight double")), "edges")
    ids = PAPERS + sorted({r[2] for r in rows} - set(PAPERS))
    nodes = materialize(spark.createDataFrame([(i, i.split(":")[0] if ":" in i else "paper", i) for i in ids], "node_id string, kind string, label string"), "nodes")
    papers = materialize(spark.createDataFrame([(p, f"paper {p}", f"text on flows and graphs {i}" if p in ("SEED", "NEAR") else f"other text {i}", 2000 + i, "v", i) for i, p in enumerate(PAPERS)], "paper_id string, title string, abstract string, year int, venue string, citation_count int"), "papers")
    return nodes, papers, edges, materialize(graph.arcs(nodes, edges), "arcs")


def pairs_of(spark):
    return spark.createDataFrame([("SEED", "NEAR"), ("SEED", "FAR")], "seed string, candidate string")


def test_paths_in_order_and_explanations(spark, corpus):
    nodes, _, _, arcs = corpus
    found = metapaths.paths(pairs_of(spark), arcs, nodes)
    near = [(r.relation, r.via) for r in found.where("candidate = 'NEAR'").orderBy("position").collect()]
    assert near == [("direct_citation", None), ("co_citation", "CITER"), ("co_citation", "R1"), ("co_citation", "R2"), ("shared_author", "author:ann"), ("shared_concept", "concept:flows")]
    said = {r.candidate: r for r in metapaths.explain(pairs_of(spark), found).collect()}
    assert len(said["NEAR"].cited_edges) == 11 and said["NEAR"].text.startswith("Links in the graph: direct citation (SEED cites NEAR)")
    alone = metapaths.explain(spark.createDataFrame([("R1", "F3")], "seed string, candidate string"), found).first()
    assert alone.cited_edges == [] and alone.path_count == 0


def test_near_needs_its_edges_more_than_far(spark, corpus):
    nodes, papers, edges, arcs = corpus
    cells = explainers.deterministic(pairs_of(spark), arcs, nodes).select("seed", "candidate", "explainer", "cited_edges")
    empty = spark.createDataFrame([("SEED", "F1", "metapath", ["gone"])], cells.schema)
    lexical = papers.select("paper_id", F.lit(0.0).alias("rrf"))  # the graph alone decides
    out = materialize(ablation.ablate(cells.unionByName(empty), "SEED", nodes, edges, arcs, materialize(lexical, "l"), trials=30, max_iter=20), "cells")
    by = {r.candidate: r for r in out.collect()}
    assert by["NEAR"].necessity > by["FAR"].necessity and by["NEAR"].displacement > 0
    assert not by["F1"].testable and by["F1"].untestable_reason.startswith("none of the cited edges") and by["F1"].displacement == 0
    assert all(0 < by[c].p_value <= 1 and by[c].sufficiency_rank >= 1 for c in ("NEAR", "FAR"))
    r = ablation.report(out).first()
    assert r.n_candidates == 3 and r.n_testable == 2 and r.empty_explanations == 1
    assert ablation.report_intervals(out)["displacement"].first().n == 2


def test_controls_have_the_cited_number(spark, corpus):
    nodes, _, edges, arcs = corpus
    cells = explainers.deterministic(pairs_of(spark), arcs, nodes).select("seed", "candidate", "explainer", "cited_edges")
    pool = ablation.control_pool(cells, edges)
    draws = ablation.control_sample(cells, pool, 5)
    assert {(r.candidate, r.n) for r in draws.select("candidate", F.size("edges").alias("n")).distinct().collect()} == {(r.candidate, len(r.cited_edges)) for r in cells.collect()}
    assert ablation.control_pool(cells, edges, disjoint=True).count() < pool.count()
    with pytest.raises(ValueError):
        ablation.guard_trials(10)


def test_search_modes(spark, corpus):
    nodes, papers, _, arcs = corpus
    vectors = papers.select("paper_id", F.array(F.col("citation_count").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    full = retrieval.search(papers, nodes, arcs, "SEED", vectors, top_k=5, max_iter=8)
    top = [r.paper_id for r in full.candidates.orderBy("position").collect()]
    assert "NEAR" in top and "SEED" not in top and len(top) == 5 and full.contributions.count() > 0
    free = retrieval.search(papers, nodes, arcs, "flows graphs", signals="bm25-only", top_k=3).candidates
    assert {r.paper_id for r in free.collect()} >= {"SEED", "NEAR"}
    assert retrieval.search(papers, nodes, arcs, "zzz", signals="bm25-only").candidates.where("bm25 <> 0").isEmpty()
    with pytest.raises(ValueError):
        retrieval.search(papers, nodes, arcs, "SEED", signals="other")


def test_models_behind_a_fake_client(spark, corpus):
    nodes, papers, _, arcs = corpus
    found = metapaths.paths(pairs_of(spark), arcs, nodes)
    calls = []

    def model(prompt):
        calls.append(prompt)
        return '```json\n{"explanation": "e", "fact_numbers": ["1", 99, "x"], "relationships": [{"relation": "shared_author"}, {"relation": "luck"}]}\n```'

    client = explainers.CachedModel({"m": model})
    g = {r.candidate: r for r in explainers.grounded(pairs_of(spark), found, client).collect()}
    assert len(g["NEAR"].cited_edges) == 1 and g["NEAR"].out_of_range == 1 and g["NEAR"].unparseable == 1
    f = {r.candidate: r for r in explainers.free(pairs_of(spark), papers, found, client).collect()}
    assert len(f["NEAR"].cited_edges) == 2 and f["NEAR"].unrealised_claims == 1 and f["FAR"].unrealised_claims == 2
    assert not any("edge" in c or "cites" in c for c in calls[2:]) and len(calls) == 4
    assert explainers.available(["metapath", "llm-free"], None) == (["metapath"], ["llm-free"])


def test_tree(spark, corpus):
    nodes, papers, _, arcs = corpus
    papers = papers.withColumn("year", F.when(F.col("paper_id") == "SEED", 2030).otherwise(F.col("year"))).withColumn("year", F.when(F.col("paper_id") == "NEAR", 2020).otherwise(F.col("year")))
    top = spark.createDataFrame([("NEAR", 1), ("R1", 2), ("R2", 3), ("F1", 4)], "paper_id string, position int")
    t = prereq.build_tree("SEED", top, papers, nodes, arcs, spark.createDataFrame([("NEAR", 0.5)], "paper_id string, necessity double"), ratio=100.0)
    tier = {n["paper_id"]: n["tier"] for n in t["nodes"]}
    assert tier == {"R1": 0, "R2": 0, "F1": 0, "NEAR": 1, "SEED": 2}
    assert {(e["prereq"], e["dependent"]) for e in t["implied_edges_removed"]} == {("R1", "SEED"), ("R2", "SEED")}
    assert t["tiers"][2] == "Tier 3 · 2030" and t["diagnostics"]["canvas_legible"]["ok"]


def test_cycles_lose_their_weakest_edge(spark):
    e = spark.createDataFrame([("a", "b", "r", 3.0, ""), ("b", "c", "r", 1.0, ""), ("c", "a", "r", 2.0, ""), ("c", "d", "r", 1.0, "")], "prereq string, dependent string, reason string, weight double, detail string")
    cut = {(r.prereq, r.dependent) for r in prereq.break_cycles(e).where("dropped").collect()}
    assert cut == {("b", "c")}
    with pytest.raises(ValueError):
        prereq.reachable(e, max_depth=6)


def test_vocabulary(spark, corpus):
    nodes, _, edges, _ = corpus
    check_vocabulary(nodes, edges)
    with pytest.raises(ValueError):
        check_vocabulary(nodes, edges.withColumn("rel", F.lit("likes")))


def test_statistics():
    assert stats.bootstrap([])["n"] == 0 and stats.bootstrap([2.0])["ci_low"] == 2.0
    d = stats.bootstrap([1.0, 2.0, 3.0, 4.0])
    assert d["ci_low"] <= d["mean"] <= d["ci_high"] and d["std"] == pytest.approx(1.29099, abs=1e-4)
    assert stats.paired_permutation([1, 2], [1, 2])["p_value"] == 1.0
    assert stats.paired_permutation([5.0] * 12, [1.0] * 12)["significant"]
    with pytest.raises(ValueError):
        stats.paired_permutation([1], [1, 2])


def test_places_made_in_tasks_equal_those_of_whole_scores(spark, corpus):
    nodes, papers, edges, arcs = corpus
    ids = [r.edge_id for r in edges.orderBy("edge_id").collect()]
    variants = spark.createDataFrame([("a", "without", [], ["NEAR", "FAR", "gone"]), ("b", "without", ids[:3], ["NEAR"]), ("c", "only", ids[3:9], ["FAR", "NEAR"])], "variant string, mode string, edges array<string>, papers array<string>")
    start = flow.personalization(nodes, spark.createDataFrame([("SEED",)], "node_id string"))
    lexical = papers.select("paper_id", (1.0 / (60 + F.col("citation_count"))).alias("rrf"))
    scores = flow.rank_variants(nodes, arcs, variants.drop("papers"), start, max_iter=4, tol=0)
    keyed = flow.rank_variants(nodes, arcs, variants.drop("papers"), start, max_iter=4, tol=0, max_arcs=3)
    wanted = variants.select("variant", F.explode("papers").alias("paper_id"))
    expect = {tuple(r) for r in ablation.corpus_ranks(scores, lexical, "SEED", wanted).join(wanted, ["variant", "paper_id"], "left_semi").select("variant", "paper_id", "position").collect()}
    assert expect == {tuple(r) for r in ablation.corpus_ranks(keyed, lexical, "SEED", wanted).join(wanted, ["variant", "paper_id"], "left_semi").select("variant", "paper_id", "position").collect()}
    assert {tuple(r) for r in flow.place_variants(nodes, arcs, variants, start, lexical, "SEED", ablation._fused, max_iter=4, tol=0).collect()} == expect and len(expect) == 5
