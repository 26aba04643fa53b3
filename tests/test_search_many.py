"""The stored index, keyed PageRank and the search for many queries against plain versions and the one-query operators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.operators import flow, graph, lexical, retrieval, search_many
from provrank.schema import with_edge_ids
from provrank.storage import materialize

TEXTS = {"p1": "graphs and flows of graphs", "p2": "flows in pipes", "p3": "", "p4": None, "p5": "the the the end", "p6": "Graphs, FLOWS & pipes!", "p7": "naïve café", "p8": "pipes"}


@pytest.fixture(scope="module")
def corpus(spark):
    papers = materialize(spark.createDataFrame([(p, f"title {p[0]}" if p != "p3" else None, t) for p, t in TEXTS.items()], "paper_id string, title string, abstract string"), "papers")
    links = [("p1", "p2"), ("p1", "p6"), ("p2", "p8"), ("p6", "p1"), ("p5", "p7"), ("p7", "p1"), ("p8", "p2")]
    edges = materialize(with_edge_ids(spark.createDataFrame([(a, "cites", b, 1.0) for a, b in links] + [(p, "published_in", "venue:hub", 1.0) for p in TEXTS if p != "p3"], "src string, rel string, dst string, weight double")), "edges")
    nodes = materialize(spark.createDataFrame([(p, "paper", p) for p in TEXTS] + [("venue:hub", "venue", "hub")], "node_id string, kind string, label string"), "nodes")
    return papers, nodes, materialize(graph.arcs(nodes, edges), "arcs")


def plain_bm25(query, k1=1.5, b=0.75):
    cut = lambda t: re.findall("[a-z0-9]+", t.lower())
    docs = {p: cut(f"{'title p' if p != 'p3' else ''}. {t or ''}".strip()) for p, t in TEXTS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return {p: sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in cut(query)) for p, d in docs.items()}


def test_index_scores_many_texts_like_plain_bm25(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/index"
    lexical.build(corpus[0], path)
    index = lexical.read(spark, path)  # stored and read again
    asked = {"a": "graphs graphs flows", "b": "the end of pipes", "c": "", "d": "unknown words", "e": "title"}
    found = {(r.query, r.paper_id): r.bm25 for r in lexical.score(index, spark.createDataFrame(list(asked.items()), "query string, text string")).collect()}
    for q, text in asked.items():
        for p, want in plain_bm25(text).items():
            assert found.get((q, p), 0.0) == pytest.approx(want, abs=1e-12)
    assert index.n == 8 and index.papers.where("paper_id = 'p3'").first().len == 0
    one = {r.paper_id: r.bm25 for r in retrieval.bm25(corpus[0], asked["a"]).collect()}
    assert all(found.get(("a", p), 0.0) == pytest.approx(x, abs=1e-12) for p, x in one.items())
    best = lexical.top(index, spark.createDataFrame([("a", asked["a"])], "query string, text string"), 2).orderBy("position").collect()
    assert [r.paper_id for r in best] == [p for p, _ in sorted(plain_bm25(asked["a"]).items(), key=lambda x: (-round(x[1], 9), x[0]))[:2]]


def test_a_search_reads_the_buckets_of_its_words(spark, corpus, tmp_path):
    index = lexical.build(corpus[0], f"file://{tmp_path}/index")
    found = lexical.score(index, spark.createDataFrame([("a", "pipes")], "query string, text string"))
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pagerank_for_many_seeds_equals_one_at_a_time(spark, corpus):
    hub_arcs = 3  # test_search_equals_one_query_at_a_time splits none
    _, nodes, arcs = corpus
    starts = {"a": {"p1": 1.0}, "b": {"p2": 0.25, "p7": 0.75}, "c": {"p3": 1.0}}  # p3 has no arc: its mass dangles
    rows = [(q, p, v) for q, own in starts.items() for p, v in own.items()]
    many = search_many.rank(arcs, spark.createDataFrame(rows, "query string, node_id string, v double"), tol=1e-2, hub_arcs=hub_arcs)
    got = {(r.query, r.node_id): r.x for r in many.scores.collect()}
    runs = {r.query: r for r in many.runs.collect()}
    for q, own in starts.items():
        seeds = spark.createDataFrame(list(own.items()), "node_id string, weight double")
        alone = flow.rank(arcs, flow.personalization(nodes, seeds), tol=1e-2)
        assert runs[q].iterations == alone.iterations and runs[q].converged == alone.converged
        for r in alone.scores.collect():
            assert got.get((q, r.node_id), 0.0) == pytest.approx(r.x, abs=1e-12)
        assert sum(x for (k, _), x in got.items() if k == q) == pytest.approx(1.0)
    assert len({r.iterations for r in runs.values()}) > 1  # some left the loop before others
    shares, hubs = search_many.split_hubs(arcs, hub_arcs)
    assert {r.src: r.salts for r in hubs.collect()}["venue:hub"] == 3 and shares.where("src = 'venue:hub'").select("salt").distinct().count() > 1


def test_search_equals_one_query_at_a_time(spark, corpus):
    papers, nodes, arcs = corpus
    vectors = spark.createDataFrame([(p, [float(i), 1.0, 0.5 * i * i]) for i, p in enumerate(TEXTS) if p != "p5"], "paper_id string, vector array<double>")
    queries = spark.createDataFrame([("p1", None), ("p5", None), ("q", "flows of pipes")], "query string, text string")
    options = {"top_k": 4, "pool_size": 5, "max_iter": 3, "tol": 0}
    index = lexical.build(papers)
    with_vectors = search_many.search(papers, nodes, arcs, index, queries.where("query = 'p1'"), vectors, **options).collect()
    without = search_many.search(papers, nodes, arcs, index, queries.where("query != 'p1'"), modes=("bm25-only", "rrf+ppr"), **options).collect()
    text = {"q": "flows of pipes"}
    for found, vec, modes in ((with_vectors, vectors, retrieval.SIGNALS), (without, None, ("bm25-only", "rrf+ppr"))):
        for q in {r.query for r in found}:
            for m in modes:
                one = retrieval.search(papers, nodes, arcs, text.get(q, q), vec, signals=m, attribute=False, **options).candidates.orderBy("position").collect()
                many = sorted((r for r in found if (r.query, r["mode"]) == (q, m)), key=lambda r: r.position)
                assert [(r.paper_id, r.position) for r in many] == [(r.paper_id, r.position) for r in one]
                assert [r.score for r in many] == pytest.approx([r.score for r in one], abs=1e-9)
    with pytest.raises(ValueError, match="unknown signals"):
        search_many.search(papers, nodes, arcs, index, queries, modes=("magic",))
    with pytest.raises(ValueError, match="needs vectors"):
        search_many.search(papers, nodes, arcs, index, queries)


def test_evaluation_counts_what_was_not_found(spark, corpus):
    arcs = corpus[2]
    queries = spark.createDataFrame([("p1",)], "query string")
    judged = search_many.relevance(arcs, queries)
    assert {(r.paper_id, r.relevance) for r in judged.collect()} == {("p2", 2.0), ("p6", 2.0), ("p7", 1.0)}
    found = spark.createDataFrame([("p1", "m", "p8", 1), ("p1", "m", "p2", 2)], "query string, mode string, paper_id string, position int")
    r = search_many.evaluate(found, judged).first()
    dcg, ideal = 3 / math.log2(3), 3 + 3 / math.log2(3) + 1 / 2
    assert r.rr == 0.5 and r.ndcg == pytest.approx(dcg / ideal)
    m = search_many.means(search_many.evaluate(found, judged)).first()
    assert (m["mode"], m.queries, m.mrr) == ("m", 1, 0.5)


def test_graphs_in_one_loop_stop_as_they_would_alone(spark, corpus):
    _, nodes, arcs = corpus
    start = flow.personalization(nodes, spark.createDataFrame([("p1",)], "node_id string"))
    some = [r.edge_id for r in arcs.select("edge_id").distinct().orderBy("edge_id").collect()]
    variants = spark.createDataFrame([("a", "without", []), ("b", "without", some[:3]), ("c", "only", some[:2]), ("d", "only", some)], "variant string, mode string, edges array<string>")
    small = {(r.variant, r.node_id): r.x for r in flow.rank_variants(nodes, arcs, variants, start, tol=1e-4).collect()}
    large = {(r.variant, r.node_id): r.x for r in flow.rank_variants(nodes, arcs, variants, start, tol=1e-4, max_arcs=0).collect()}
    assert set(small) == set(large) and all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)


def test_resampling_by_columns_equals_the_plain_draws(spark):
    from provrank.functions import stats

    rows = [("a", 1.0), ("a", 5.0), ("a", 2.0), ("a", None), ("b", 7.0), ("c", None), (None, 3.0)] + [("d", float(k * k % 17)) for k in range(30)]
    got = {r.g: r.asDict() for r in stats.bootstrap_by(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v", samples=200).collect()}
    assert set(got) == set("abcd")
    for g, r in got.items():
        want = stats.bootstrap([v for k, v in rows if k == g and v is not None], samples=200)
        assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)
    pairs = [("a", float(k % 5), 1.0) for k in range(12)] + [("b", 2.0, 2.0)] * 3 + [("c", 5.0, 1.0)] * 9 + [("a", None, 1.0)]
    found = {r.g: r.asDict() for r in stats.paired_by(spark.createDataFrame(pairs, "g string, x double, y double"), "g", "x", "y", flips=333).collect()}
    for g, r in found.items():
        own = [(x, y) for k, x, y in pairs if k == g and x is not None]
        want = stats.paired_permutation([x for x, _ in own], [y for _, y in own], flips=333)
        assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-9)
    assert found["c"]["significant"] and found["b"]["p_value"] == 1.0
    many = [stats.draw(42, s, 3, 7) for s in range(7000)]
    assert all(850 < many.count(k) < 1150 for k in range(7)) and 4800 < sum(stats.sign(1, f, 0) > 0 for f in range(10_000)) < 5200


def test_equal_words_in_any_order_score_alike(spark):
    """Scores of copies tie exactly, however their words were summed."""
    import random

    words = [f"w{i}" * (i % 5 + 1) for i in range(60)]
    rng = random.Random(4)
    copies = [(f"c{i:03d}", "", " ".join(rng.sample(words, 60))) for i in range(150)]
    others = [(f"o{i:03d}", "", " ".join(words[: i % 60 : 2])) for i in range(240)]
    papers = spark.createDataFrame(copies + others, "paper_id string, title string, abstract string")
    text = ". " + " ".join(words + words[::3])
    assert retrieval.bm25(papers.repartition(7), text).where("paper_id like 'c%'").select("bm25").distinct().count() == 1
    index = lexical.build(papers.repartition(7))
    assert lexical.score(index, spark.createDataFrame([("q", text)], "query string, text string")).where("paper_id like 'c%'").select("bm25").distinct().count() == 1


def test_ranking_in_tasks_equals_the_dataflow(spark, corpus):
    _, nodes, arcs = corpus
    rows = [("a", "p1", 1.0), ("b", "p2", 0.25), ("b", "p7", 0.75), ("c", "p3", 1.0)]  # p3 has no arc: its mass dangles
    start = spark.createDataFrame(rows, "query string, node_id string, v double")
    for options in ({"max_iter": 60, "tol": 1e-10, "alpha": 0.5}, {"max_iter": 5, "tol": 0}):
        one, other = search_many.rank(arcs, start, **options), search_many.rank_in_tasks(arcs, start, **options)
        want = {(r.query, r.node_id): r.x for r in one.scores.collect()}
        got = {(r.query, r.node_id): r.x for r in other.scores.collect()}
        assert set(got) == set(want) and all(x == pytest.approx(want[k], abs=1e-14) for k, x in got.items())
        ended = lambda found: {r.query: (r.iterations, r.converged) for r in found.runs.collect()}
        assert ended(other) == ended(one)


def test_a_search_over_a_small_graph_ranks_it_in_tasks(spark, corpus, monkeypatch):
    papers, nodes, arcs = corpus

    def refuse(*_, **__):
        raise AssertionError("ranked by a dataflow of queries times arcs")

    monkeypatch.setattr(search_many, "rank", refuse)
    found = search_many.search(papers, nodes, arcs, lexical.build(papers), spark.createDataFrame([("q", "graphs")], "query string, text string"), modes=("rrf+ppr",), max_iter=3, tol=0)
    assert found.count() == 8


@pytest.mark.parametrize("max_words", [lexical.MAX_WORDS, 40])
def test_the_best_papers_are_found_without_a_row_for_each_pair(spark, max_words, monkeypatch):
    monkeypatch.setattr(lexical, "score", None)  # which makes a row for each query and paper
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefghij") * r.choice((1, 2)) for _ in range(r.randrange(0, 9))) for _ in range(60)]
    texts += texts[:20]  # ties
    papers = spark.createDataFrame([(f"p{i:02}", "", t) for i, t in enumerate(texts)], "paper_id string, title string, abstract string")
    index = lexical.build(papers)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*texts[:25], "none of them", ""])], "query string, text string")
    monkeypatch.undo()
    w = Window.partitionBy("query").orderBy(F.round("bm25", 9).desc(), "paper_id")
    rows = lexical.score(index, queries).withColumn("position", F.row_number().over(w)).where("position <= 4").collect()
    want = {(x.query, x.position): (x.paper_id, round(x.bm25, 9)) for x in rows}
    monkeypatch.setattr(lexical, "score", None)
    monkeypatch.setattr(lexical, "CELLS", 100)
    found = lexical.top(index, queries, 4, max_words=max_words).collect()
    assert {(x.query, x.position): (x.paper_id, round(x.bm25, 9)) for x in found} == want and len(found) == len(want) > 60
