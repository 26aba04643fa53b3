"""The coded citation graph, ranking and paths over any type of id, and what is not moved."""

import pytest
from pyspark.sql import functions as F

from provrank.operators import flow, graph, metapaths
from provrank.schema import edge_code, edge_id, edge_name, with_edge_ids
from provrank.sources import fixtures


def test_edge_codes_name_their_ids_and_order_like_them(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("a")).select(edge_id(F.col("a"), F.lit("cites"), F.lit("b")).alias("e"), edge_code(F.col("a"), F.lit("cites"), F.lit("b")).alias("c"))
    got = rows.select("e", "c", edge_name(F.col("c")).alias("again")).collect()
    assert all(r.e == r.again for r in got)
    assert [r.e for r in sorted(got, key=lambda r: r.c)] == sorted(r.e for r in got)


def test_coded_corpus_is_the_named_one(spark, small):
    a, b = fixtures.orders_corpus(spark, small), fixtures.orders_coded(spark, small)
    want, got = ({(r.edge_id, r.src, r.rel, r.dst) for r in x.select("edge_id", "src", "rel", "dst").collect()} for x in (a.edges, b.edges.select(edge_name(F.col("edge_id")).alias("edge_id"), b.name(F.col("src")).alias("src"), "rel", b.name(F.col("dst")).alias("dst"))))
    assert want == got
    nodes = b.nodes.select("node_id", b.name(F.col("node_id")).alias("name"), "kind", "label").orderBy("node_id").collect()
    assert [(r.name, r.kind, r.label) for r in nodes] == [tuple(r) for r in a.nodes.select("node_id", "kind", "label").orderBy("node_id").collect()]


@pytest.mark.parametrize("max_list", [256, 2])
def test_paths_of_crowded_papers_are_joined_instead(spark, max_list):
    pairs = [("a", "b"), ("b", "a"), ("a", "x"), ("b", "x"), ("y", "a"), ("y", "b"), ("c", "x"), ("c", "d")]
    nodes = spark.createDataFrame([(n, "paper", n.upper()) for n in "abcdxy"], "node_id string, kind string, label string")
    edges = with_edge_ids(spark.createDataFrame([(s, "cites", d, 1.0) for s, d in pairs], "src string, rel string, dst string, weight double"))
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "y"), ("a", "nowhere")], "seed string, candidate string")
    found = metapaths.paths(asked, graph.arcs(nodes, edges), nodes, max_list=max_list).collect()
    got = sorted((r.seed, r.candidate, r.position, r.relation, r.via, r.detail, len(r.edge_ids)) for r in found)
    assert got == [("a", "b", 1, "direct_citation", None, "A cites B", 1), ("a", "b", 2, "direct_citation", None, "B cites A", 1), ("a", "b", 3, "co_citation", "x", "both cite X", 2), ("a", "b", 4, "co_citation", "y", "both cited by Y", 2), ("a", "c", 1, "co_citation", "x", "both cite X", 2)]


def test_ranking_takes_numbers_and_writes_no_flows_unless_asked(spark):
    arcs = spark.createDataFrame([(i, i % 5, "cites", (i * 3 + 1) % 5, 1.0 + i) for i in range(12)], "edge_id long, src long, rel string, dst long, weight double")
    start = spark.createDataFrame([(n, float(n == 0)) for n in range(6)], "node_id long, v double")  # 5 dangles and is never reached
    with_flows, bare = flow.rank(arcs, start, max_iter=6, tol=0), flow.rank(arcs, start, max_iter=6, tol=0, flows=False)
    assert bare.flows is None and with_flows.flows.count() == 12
    want, got = ({r.node_id: r.x for r in f.scores.collect()} for f in (with_flows, bare))
    assert set(got) == set(range(6)) and all(abs(got[n] - want[n]) < 1e-15 for n in got) and abs(sum(got.values()) - 1) < 1e-12


def test_edge_digest_is_made_in_tasks(spark):
    from hashlib import sha256

    ids = [f"e{i:016x}" for i in range(2000)]
    edges = spark.createDataFrame([(e,) for e in [*ids[::-1], *ids[:50]]], "edge_id string").repartition(7)
    found = graph.edge_digest(edges)  # rows of a DataFrame: no id has come to the driver
    assert found.collect()[0].digest == sha256("".join(ids).encode()).hexdigest()[:16]


def test_draws_are_never_sent_to_the_driver(spark):
    from provrank.functions import stats

    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(60)], "g long, v double")
    plan = stats.bootstrap_by(rows, "g", "v", samples=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
