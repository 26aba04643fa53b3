"""Power iteration in blocks of nodes against plain numpy, and what its steps send."""

import random

import pytest
from pyspark.sql import functions as F

from provrank.operators import blocks, flow
from tests.test_flow import naive


@pytest.mark.parametrize("kind,homed", [("string", False), ("long", True)])
def test_ranking_in_blocks_is_plain_ranking(spark, kind, homed):
    r = random.Random(5)
    name = (lambda i: f"n{i:03}") if kind == "string" else (lambda i: i * 7)
    nodes = [name(i) for i in range(60)]
    rows = [(name(r.randrange(50)), name(r.choice([0, r.randrange(60)])), r.random() + 0.1) for _ in range(400)]  # the last ten have no arcs
    home = {n: i % 9 for i, n in enumerate(nodes)}
    arcs = spark.createDataFrame([(*x, home[x[0]], home[x[1]]) for x in rows], f"src {kind}, dst {kind}, weight double, src_home long, dst_home long").withColumns({"edge_id": F.lit("e"), "rel": F.lit("cites")})
    start = spark.createDataFrame([(n, float(n == nodes[3]), home[n]) for n in nodes], f"node_id {kind}, v double, home long")
    if not homed:
        arcs, start = arcs.drop("src_home", "dst_home"), start.drop("home")
    found = flow.rank(arcs, start, max_iter=6, tol=0, flows=False)
    got, want = {x.node_id: x.x for x in found.scores.collect()}, naive(rows, nodes, nodes[3], 0.15, 7)
    assert set(got) == set(nodes) and all(abs(got[n] - want[n]) < 1e-14 for n in nodes)


def test_a_step_sends_numbers_once_and_nothing_within_a_home(spark):
    # hub 0 has an arc to and from each of 400 leaves; leaves come in pairs of one home, with arcs between them
    pairs = [(0, i) for i in range(1, 401)] + [(i, 0) for i in range(1, 401)] + [(i, i + 1) for i in range(1, 401, 2)]
    home = lambda c: F.ceil(F.col(c) / 2)
    arcs = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").withColumns({"src_home": home("src"), "dst_home": home("dst")})
    start = spark.range(401).select(F.col("id").alias("node_id"), F.lit(1.0 / 401).alias("v"), home("id").alias("home"))
    b = blocks.build(arcs, start)
    sent = b.out.where(F.col("role") != blocks.INNER).agg(F.sum(F.when(F.col("role") == blocks.SUMS, F.col("n")).otherwise(F.length("x") / 4))).first()[0]
    assert 0 < sent <= 2 * 3  # to and from each of the other blocks one number, for 800 arcs
    assert b.out.where(F.col("role") == blocks.INNER).agg(F.sum(F.length("x") / 4)).first()[0] >= 200
    b.close()


def test_an_arc_to_a_stranger_is_an_error(spark):
    arcs = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    with pytest.raises(Exception, match="doesn't name"):
        blocks.build(arcs, spark.createDataFrame([("a", 1.0)], "node_id string, v double"))
