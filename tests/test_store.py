"""Snapshots: what a reader sees before, during and after writes, and what a lookup reads."""

import pytest
from pyspark.sql import functions as F

from provrank import store
from provrank.schema import with_edge_ids


def graph(spark, n, kind="paper"):
    papers = spark.range(n).select(F.format_string("p%06d", "id").alias("paper_id"), F.lit(None).cast("string").alias("title"), F.lit("x").alias("abstract"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    nodes = papers.select(F.col("paper_id").alias("node_id"), F.lit(kind).alias("kind"), F.col("paper_id").alias("label"))
    edges = with_edge_ids(papers.select(F.col("paper_id").alias("src"), F.lit("cites").alias("rel"), F.lit("p000000").alias("dst"), F.lit(1.0).alias("weight")))
    return nodes, papers, edges


def test_snapshots_commit_fail_and_roll_back(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    with pytest.raises(store.NoGraph):
        store.load(spark, folder)
    first = store.save(spark, folder, *graph(spark, 10), note="one")
    seen = store.load(spark, folder)
    second = store.save(spark, folder, *graph(spark, 20))
    assert seen.papers.count() == 10 and store.load(spark, folder).papers.count() == 20  # the old reader goes on reading the old graph
    with pytest.raises(ValueError, match="unknown kind"):
        store.save(spark, folder, *graph(spark, 5, kind="planet"))
    broken = graph(spark, 5)[1].withColumn("title", F.raise_error(F.lit("disk full")))
    with pytest.raises(Exception, match="disk full"):
        store.save(spark, folder, graph(spark, 5)[0], broken, graph(spark, 5)[2])
    now = store.load(spark, folder)
    assert now.snapshot == second and now.papers.count() == 20
    assert [s["name"] for s in store.state(spark, folder)["snapshots"]] == [first, second]
    assert store.rollback(spark, folder) == first and store.load(spark, folder).papers.count() == 10
    with pytest.raises(store.NoGraph):
        store.rollback(spark, folder)
    assert store.rollback(spark, folder, second) == second
    with pytest.raises(store.NoGraph):
        store.load(spark, folder, "other")


def test_a_newer_schema_is_refused(spark, tmp_path):
    (tmp_path / "CURRENT.json").write_text('{"schema_version": 99, "current": "x", "snapshots": []}')
    with pytest.raises(ValueError, match="schema version 99"):
        store.load(spark, f"file://{tmp_path}")


def test_lookups_read_few_files_and_scans_filter(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    store.save(spark, folder, *graph(spark, 20_000), files=6)
    g = store.load(spark, folder)
    assert len(g.papers.inputFiles()) == 6
    row = store.lookup(g.papers, "paper_id", ["p000123", "absent"])
    assert [r.paper_id for r in row.collect()] == ["p000123"]
    assert "PushedFilters: [In(paper_id" in row._jdf.queryExecution().executedPlan().toString()
    files = row.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 1
    spans = [spark.read.parquet(f).agg(F.min("paper_id"), F.max("paper_id")).first() for f in g.papers.inputFiles()]
    spans = sorted((a, b) for a, b in spans)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))  # files' ids don't overlap
    assert store.papers(g, "a").count() == 10_000 and store.papers(g).where("title != ''").count() == 0
    assert store.nodes_of(g, "paper").count() == 20_000 and store.nodes_of(g, "venue").count() == 0
    assert store.lookup(g.papers, "paper_id", []).count() == 0
    with pytest.raises(ValueError):
        store.lookup(g.papers, "paper_id", ["x"] * 10_001)
