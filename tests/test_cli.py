"""The command line from records to artifacts, on a small corpus in files."""

import json

import pytest

from provrank import artifact, cli, store
from provrank.config import Config

#: A seed, what it cites, and papers that share only a venue with it.
CITES = {"seed": ["near", "r1", "r2"], "near": ["r1", "r2"], "citer": ["seed", "near"], "f1": ["f2"], "f2": ["f3"]}
PAPERS = ["seed", "near", "r1", "r2", "citer", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    rows = [
        {"id": p, "title": f"Paper {p}", "abstract": f"Flows and graphs of {p}" if p in ("seed", "near") else f"Other matter {p}", "year": 2000 + k, "n_citation": 10 - k,
         "venue": {"raw": "Hub" if p in ("seed", "f1", "f2", "f3") else f"V {p}"}, "authors": [{"id": "ann" if p in ("seed", "near") else p, "name": p}], "references": CITES.get(p, [])}
        for k, p in enumerate(PAPERS)
    ]
    (folder / "records.json").write_text(json.dumps(rows, indent=1))
    (folder / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (folder / "settings.toml").write_text('[ablation]\ntrials = 25\n[ppr]\nmax_iter = 20\n[files]\nseeds = "seeds.txt"\n')
    (folder / "seeds.txt").write_text("dblp:seed  # the one\n\ndblp:absent\n")
    return folder


def run(corpus, command, *more, out="out.json"):
    code = cli.main([command, f"{corpus}/graph", "--config", f"{corpus}/settings.toml", "--out", f"{corpus}/{out}", *more])
    return code, artifact.read(corpus / out)


@pytest.fixture(scope="module")
def built(corpus):
    return run(corpus, "build", "--source", "dblp", "--path", f"{corpus}/records.json")


def test_build_from_an_array_and_from_lines(spark, corpus, built):
    code, said = built
    assert code == 0 and said["nodes"]["paper"] == 8 and said["edges"] == {"authored_by": 8, "cites": 9, "published_in": 8} and not said["no_citations"]
    code, again = run(corpus, "build", "--source", "dblp", "--path", f"{corpus}/lines.jsonl")
    assert code == 0 and again["digest"] == said["digest"] and again["snapshot"] != said["snapshot"]
    assert run(corpus, "rollback")[1]["current"] == said["snapshot"] == store.load(spark, f"{corpus}/graph").snapshot


def test_build_without_citations_ends_with_2(corpus, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "title": "A"}\n{"id": "b", "title": "B"}')
    assert cli.main(["build", f"{tmp_path}/g", "--source", "dblp", "--path", f"{tmp_path}/x.jsonl", "--out", f"{tmp_path}/o.json"]) == 2


def test_build_from_recorded_calls(tmp_path, spark):
    record = lambda p: {"paperId": p, "title": p, "authors": [{"authorId": "1", "name": "A"}]}
    calls = [("paper", "p1", [record("p1")]), ("references", "p1", [record("p2")]), ("citations", "p1", [record("p3")]), ("references", "p2", []), ("citations", "p2", [record("p3")]), ("references", "p3", [])]
    (tmp_path / "calls.jsonl").write_text("\n".join(json.dumps({"call": c, "key": k, "records": r}) for c, k, r in calls))
    (tmp_path / "seeds").write_text("p1\nmissing\n")
    code = cli.main(["build", f"{tmp_path}/g", "--source", "s2-calls", "--path", f"{tmp_path}/calls.jsonl", "--seeds", f"{tmp_path}/seeds", "--out", f"{tmp_path}/o.json"])
    said = artifact.read(tmp_path / "o.json")
    assert code == 0 and said["papers"] == 3 and said["edges"]["cites"] == 3 and said["seeds_resolved"] == 1 and said["seeds_failed"] == 1
    assert said["expansion_calls_failed"] == 2 and said["expansion_degraded"]  # the seed that wasn't recorded, and p3's citations


def test_search_ranks_attributes_and_leaves_the_seed_out(corpus, built, capsys):
    code, said = run(corpus, "search", "--query", "dblp:seed", "--top-k", "3")
    names = [c["paper_id"] for c in said["candidates"]]
    assert said["decomposition_error"] < 1e-12 and said["provenance"]["corpus_digest"]
    assert code == 0 and len(names) == 3 and names[0] == "dblp:near" and "dblp:seed" not in names and said["provenance"]["config"]["ppr"]["max_iter"] == 20
    assert {c["candidate"] for c in said["contributions"]} <= set(names) and all(0 < c["credit"] <= 3 for c in said["contributions"])
    assert cli.main(["search", f"{corpus}/graph", "--query", "other matter", "--signals", "bm25-only"]) == 0
    free = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert free["candidates"] and "contributions" not in free


def test_explain_names_paths_and_an_unknown_paper_has_none(corpus, built):
    _, said = run(corpus, "explain", "--query", "dblp:seed", "--candidate", "dblp:near")
    assert [p["relation"] for p in said["paths"]][0] == "direct_citation" and {"shared_author", "co_citation"} <= {p["relation"] for p in said["paths"]}
    assert set(said["explanation"]["cited_edges"]) >= {e for p in said["paths"] for e in p["edge_ids"]}
    assert run(corpus, "explain", "--query", "dblp:seed", "--candidate", "dblp:nobody")[1]["paths"] == []


def test_ablate_and_tree(corpus, built):
    code, said = run(corpus, "ablate", "--query", "dblp:seed", "--top-k", "3", out="ablate_seed.json")
    assert code == 0 and len(said["cells"]) == 3 and said["report"][0]["n_candidates"] == 3
    assert said["skipped_explainers"] == ["llm-grounded", "llm-free"] and all(c["control_trials"] == 25 for c in said["cells"] if c["testable"])
    assert all(c["note"] for c in said["cells"]) and {"displacement", "paired_test"} <= set(said["intervals"])
    code, tree = run(corpus, "tree", "--query", "dblp:seed", "--top-k", "4", out="tree_seed.json")
    assert code == 0 and tree["seed"] == "dblp:seed" and any(n["paper_id"] == "dblp:seed" for n in tree["nodes"])
    assert {r["kind"] for r in artifact.manifest(corpus)["runs"]} == {"ablate", "tree"}


def test_eval_of_given_seeds(corpus, built):
    code, said = run(corpus, "eval", "--seeds", f"{corpus}/seeds.txt")
    assert code == 0 and set(said["modes"]) == {"bm25-only", "rrf-only", "rrf+ppr"}
    (corpus / "no_seeds.txt").write_text("dblp:absent\n")
    assert run(corpus, "eval", "--seeds", f"{corpus}/no_seeds.txt")[0] == 1
    both = said["modes"]["rrf+ppr"]
    assert [q["query"] for q in both["ndcg"]] == ["dblp:seed"] and 0 < both["mean_ndcg"] <= 1 and both["mrr"] == 1.0


def test_errors_are_raised(corpus, built, tmp_path):
    with pytest.raises(store.NoGraph):
        cli.main(["search", f"{tmp_path}/none", "--query", "x"])
    with pytest.raises(SystemExit):
        cli.main(["paint", f"{corpus}/graph"])
    with pytest.raises(ValueError, match="unknown signals"):
        cli.main(["search", f"{corpus}/graph", "--query", "x", "--signals", "magic"])


def test_settings_file(corpus):
    c = Config.load(corpus / "settings.toml")
    assert c.get("ablation.trials") == 25 and c.get("ablation.alpha_level") == 0.05 and c.resolve("files.seeds") == corpus / "seeds.txt"
    assert c.with_value("ppr.alpha", 0.4).section("ppr") == {"alpha": 0.4, "max_iter": 20, "tol": 1e-10}
    with pytest.raises(FileNotFoundError):
        Config.load(corpus / "none.toml")
