"""PageRank, its flows and attribution, on a diamond and on random graphs against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provrank.operators import flow, graph
from provrank.schema import with_edge_ids


def make(spark, pairs):
    nodes = sorted({x for p in pairs for x in p})
    n = spark.createDataFrame([(x, "paper", x) for x in nodes], "node_id string, kind string, label string")
    e = with_edge_ids(spark.createDataFrame([(a, "cites", b, 1.0) for a, b in pairs], "src string, rel string, dst string, weight double"))
    return n, e


DIAMOND = [("seed", "a"), ("seed", "b"), ("a", "target"), ("b", "target"), ("seed", "decoy")]


def naive(arcs, nodes, seed, alpha, steps):
    x = {n: float(n == seed) for n in nodes}
    out = {n: sum(w for s, _, w in arcs if s == n) for n in nodes}
    for _ in range(steps):
        lost = sum(x[n] for n in nodes if not out[n])
        new = {n: (alpha + (1 - alpha) * lost) * (n == seed) for n in nodes}
        for s, d, w in arcs:
            new[d] += (1 - alpha) * x[s] * w / out[s]
        x = new
    return x


def test_mass_flow_and_decomposition(spark):
    n, e = make(spark, DIAMOND)
    arcs = graph.arcs(n, e)
    f = flow.rank(arcs, flow.personalization(n, spark.createDataFrame([("seed",)], "node_id string")), alpha=0.5, max_iter=60, tol=1e-6)
    got = {r.node_id: r.x for r in f.scores.collect()}
    assert f.converged and f.residual < 1e-6 and abs(sum(got.values()) - 1) < 1e-9
    assert flow.decomposition_error(f).first().error < 1e-12
    rows = [(r.src, r.dst, r.weight) for r in arcs.collect()]
    want = naive(rows, sorted(got), "seed", 0.5, f.iterations + 1)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert arcs.groupBy("edge_id").count().where("count = 2").count() == 5
    credit = flow.attribute(f, spark.createDataFrame([("target",)], "node_id string"), max_depth=1).collect()
    assert {r.src for r in credit} == {"a", "b"} and sum(r.credit for r in credit) <= 1 + 1e-12
    assert [r.position for r in credit] == [1, 2]


def test_unconverged_run_says_so(spark):
    n, e = make(spark, DIAMOND)
    f = flow.rank(graph.arcs(n, e), flow.personalization(n, None), max_iter=1)
    assert not f.converged and f.iterations == 1 and flow.decomposition_error(f).first().error < 1e-12


def test_missing_seed_is_uniform_and_weights_normalise(spark):
    n, _ = make(spark, DIAMOND)
    v = [r.v for r in flow.personalization(n, spark.createDataFrame([("nowhere",)], "node_id string")).collect()]
    assert v == [0.2] * 5
    w = {r.node_id: r.v for r in flow.personalization(n, spark.createDataFrame([("a", 3.0), ("b", 1.0), ("x", 9.0)], "node_id string, weight double")).collect()}
    assert w["a"] == 0.75 and w["b"] == 0.25 and w["seed"] == 0


@pytest.mark.parametrize("limit", [10**6, 3])
def test_variants_on_arrays_and_as_one_dataflow_agree(spark, limit):
    r = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    n, e = make(spark, sorted({(r.choice(names), r.choice(names)) for _ in range(26)} - {(x, x) for x in names}))
    arcs = graph.arcs(n, e)
    ids = [x.edge_id for x in e.orderBy("edge_id").collect()]
    variants = spark.createDataFrame([("none", "without", []), ("two", "without", ids[:2]), ("only", "only", ids[3:9])], "variant string, mode string, edges array<string>")
    seed = n.orderBy("node_id").first().node_id
    start = flow.personalization(n, spark.createDataFrame([(seed,)], "node_id string"))
    got = {(x.variant, x.node_id): x.x for x in flow.rank_variants(n, arcs, variants, start, max_iter=5, tol=0, max_arcs=limit).collect()}
    rows = [(a.edge_id, a.src, a.dst, a.weight) for a in arcs.collect()]
    for v, keep in (("none", lambda i: True), ("two", lambda i: i not in ids[:2]), ("only", lambda i: i in ids[3:9])):
        want = naive([(s, d, w) for i, s, d, w in rows if keep(i)], [x.node_id for x in n.collect()], seed, 0.15, 6)
        assert all(abs(got[v, k] - x) < 1e-12 for k, x in want.items())


def test_weights_and_directions(spark):
    n = spark.createDataFrame([("p", "paper", ""), ("q", "paper", ""), ("w", "author", "")], "node_id string, kind string, label string")
    e = with_edge_ids(spark.createDataFrame([("p", "cites", "q", 0.0), ("p", "authored_by", "w", 2.0), ("p", "cites", "gone", 1.0)], "src string, rel string, dst string, weight double"))
    got = {(a.src, a.rel, a.dst): a.weight for a in graph.arcs(n, e).collect()}
    assert got == {("p", "cites", "q"): 1.0, ("q", "cited_by", "p"): 1.0, ("p", "authored_by", "w"): 1.2, ("w", "wrote", "p"): 1.2}
    assert graph.arcs(n, e, {"cites": 0.0, "cited_by": 0.0}).count() == 2


def test_hops_neighbourhood_and_digest(spark):
    n, e = make(spark, DIAMOND)
    seeds = spark.createDataFrame([("seed",)], "node_id string")
    assert {r.node_id: r.hop for r in graph.hops(e, seeds, 5).collect()} == {"seed": 0, "a": 1, "b": 1, "decoy": 1, "target": 2}
    assert graph.hops(e, seeds, 5, max_nodes=3).count() == 3
    assert graph.edge_digest(e) == graph.edge_digest(e.orderBy(F.desc("edge_id"))) and len(graph.edge_digest(e)) == 16
    shown, links = graph.neighbourhood(graph.arcs(n, e), n, spark.createDataFrame([("seed",), ("a",)], "node_id string"))
    assert shown.count() == 2 and links.count() == 1


def test_power_keeps_mass():
    rng = np.random.default_rng(0)
    src, dst = rng.integers(0, 20, 60), rng.integers(0, 20, 60)
    v = np.full(20, 0.05)
    assert abs(flow.power(src, dst, rng.random(60) + 0.1, v, 0.15, 40, 0).sum() - 1) < 1e-12
