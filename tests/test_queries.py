"""Every registered query of the core against its SQL on the smallest tables; the rest must run."""

import duckdb
import pytest

import __spark_entry__ as entry
from provrank.plans.queries import ORACLES, QUERIES

#: Several share one plan; the driver checks all of them.
QUICK = ["edge_ids", "tokens", "arcs", "out_strength", "without_edges", "in_corpus_citations", "satellites_topk", "papers_merged", "nodes_merged", "ppr_flow", "ppr_dangling", "attribution", "rrf", "search_rrf_ppr", "metapaths_top12", "claims_grounding", "control_sample", "ablation_cells", "ndcg", "monte_carlo_p", "prereq_merged", "transitive_reduction", "tier_labels", "concept_edges", "abstract_rebuild", "malformed_json_dropped", "prereq_canonical", "cache_misses", "ppr_decomposition", "ppr_converged", "tiers", "tier_rows", "records_scholar", "records_openalex", "records_s2orc", "records_dblp", "sufficiency_and_verdict", "tree_members", "cited_edges"]


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def canon(df):
    def one(v):
        if v is None or v != v:
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(map(one, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, small, db, name):
    assert canon(QUERIES[name](spark, small).toPandas()) == canon(db.sql(ORACLES[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20


def test_rows_only_queries_run(spark, small):
    for name in ("bootstrap", "paired_permutation", "keyphrases"):
        assert QUERIES[name](spark, small).count() > 0


def test_canonical_edges_take_all_papers(spark, small, db):
    assert "BETWEEN 1996" not in ORACLES["prereq_canonical"] + ORACLES["prereq_merged"]
    assert len(QUERIES["cache_misses"](spark, small).toPandas()) > 0


def test_a_broken_subpackage_is_an_error(monkeypatch):
    assert entry._optional("no_such_module") is None
    monkeypatch.setattr(entry, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("x", name="xxhash")))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("provrank.llm.queries", "provrank.llm")
