"""Walks over packed arcs against the dataflows, with pieces so small that nodes' arcs lie over several."""

import pytest
from pyspark.sql import functions as F

from provrank.operators import flow, graph, packed, search_many
from provrank.schema import with_edge_ids
from provrank.storage import materialize


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"p{i:02}", "cites", f"p{i * 7 % 30:02}", 1.0 + i % 3) for i in range(30) if i % 5] + [(f"p{i:02}", "published_in", "venue:hub", 0.5) for i in range(0, 30, 2)]
    edges = with_edge_ids(spark.createDataFrame(rows, "src string, rel string, dst string, weight double"))
    nodes = spark.createDataFrame([(f"p{i:02}", "paper", "") for i in range(32)] + [("venue:hub", "venue", "")], "node_id string, kind string, label string")
    return materialize(nodes, "nodes"), materialize(edges, "edges"), materialize(graph.arcs(nodes, edges), "arcs")


def test_a_graph_of_more_arcs_than_a_piece_is_walked_in_tasks(spark, corpus, monkeypatch):
    nodes, _, arcs = corpus
    monkeypatch.setattr(flow, "MAX_ARCS", 3, raising=False)
    monkeypatch.setattr(packed, "PIECE", 4, raising=False)
    monkeypatch.setattr(packed, "HELD", 2 * 24 * 33, raising=False)  # two walks at a time
    start = flow.personalization(nodes, spark.createDataFrame([("p01",), ("p31",)], "node_id string"))
    some = [r.edge_id for r in arcs.select("edge_id").distinct().orderBy("edge_id").collect()]
    at_p02 = [r.edge_id for r in arcs.where("src = 'p02'").select("edge_id").collect()]
    rows = [("all", "without", []), ("few", "without", some[:3]), ("alone", "without", at_p02), ("only", "only", some[4:9]), ("none", "only", [])]
    variants = spark.createDataFrame(rows, "variant string, mode string, edges array<string>")
    large = {(r.variant, r.node_id): r.x for r in flow.rank_variants(nodes, arcs, variants, start, max_iter=3, tol=0, max_arcs=0).collect()}
    monkeypatch.setattr(flow, "rank", None)  # a row for each variant and arc
    small = {(r.variant, r.node_id): r.x for r in flow.rank_variants(nodes, arcs, variants, start, max_iter=3, tol=0).collect()}
    assert len(small) == 5 * 33 and all(x == pytest.approx(large.get(k, 0.0), abs=1e-14) for k, x in small.items())


def test_many_seeds_walk_at_once(spark, corpus, monkeypatch):
    _, _, arcs = corpus
    start = spark.createDataFrame([("a", "p01", 1.0), ("b", "p02", 0.5), ("b", "p31", 0.5), ("c", "p07", 1.0)], "query string, node_id string, v double")
    want = {(r.query, r.node_id): r.x for r in search_many.rank(arcs, start, alpha=0.5, max_iter=14, tol=2e-3, hub_arcs=5).scores.collect()}
    monkeypatch.setattr(packed, "PIECE", 4, raising=False)
    found = search_many.rank_in_tasks(arcs, start, alpha=0.5, max_iter=14, tol=2e-3)
    got = {(r.query, r.node_id): r.x for r in found.scores.collect()}
    assert set(got) == set(want) and all(x == pytest.approx(want[k], abs=1e-14) for k, x in got.items())
    assert found.runs.where(F.col("converged")).count() == 3


def test_explained_cells_list_only_the_arcs_at_their_ends(spark, small, monkeypatch):
    from provrank.plans import queries

    given, paths = [], queries.metapaths.paths
    monkeypatch.setattr(queries.metapaths, "paths", lambda pairs, arcs, *more: given.append((pairs, arcs)) or paths(pairs, arcs, *more))
    assert queries.QUERIES["control_sample"](spark, small).count() > 0
    pairs, arcs = given[0]
    ends = {x for r in pairs.collect() for x in r}
    assert all(r.src in ends or r.dst in ends for r in arcs.select("src", "dst").collect())
