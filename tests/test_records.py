import json

import pytest

from provrank import artifact
from provrank.config import Config
from provrank.functions.text import parse_json_object, slug_of
from provrank.sources import records, recorded
from provrank.streaming.edges import append_edges, merged


def lines(spark, tmp_path, rows):
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return records.read_jsonl(spark, str(p))


def test_s2orc_shapes(spark, tmp_path):
    rows = [
        {"corpusid": 1, "title": "A", "abstract": {"text": "abs"}, "year": 2001, "venue": {"name": "V"}, "authors": [{"authorId": "7", "name": "N"}, "Bare"], "citations": [2, {"corpusid": 3}, 2, "s2orc:9"], "s2fieldsofstudy": [{"category": "CS"}]},
        '{"corpusId": "2", "title": null},', "broken {", "[1]", "", {"paper_id": 3, "references": [1, 3], "fields": ["Math", "Math"]}, {"title": "no id"},
    ]
    papers = records.s2orc_papers(lines(spark, tmp_path, rows))
    by = {r.paper_id: r for r in papers.collect()}
    assert set(by) == {"s2orc:1", "s2orc:2", "s2orc:3"}
    one = by["s2orc:1"]
    assert (one.abstract, one.venue, one.year, one.fields) == ("abs", "V", 2001, ["CS"]) and one.citations == ["s2orc:2", "s2orc:3", "s2orc:9"]
    assert [a.author_id for a in one.authors] == ["7", "Bare"] and by["s2orc:2"].title == "" and by["s2orc:3"].fields == ["Math"]
    nodes, edges = records.to_graph(papers)
    cites = {(r.src, r.dst) for r in edges.where("rel = 'cites'").collect()}
    assert cites == {("s2orc:1", "s2orc:2"), ("s2orc:1", "s2orc:3"), ("s2orc:3", "s2orc:1")}
    assert records.health(nodes, edges)["edges"]["cites"] == 3 and not records.health(nodes, edges)["no_citations"]


def test_dblp_openalex_and_graph_api(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"_id": "x", "title": "T", "venue": {"raw": "R"}, "n_citation": 4, "references": ["y"], "fos": [{"name": "F"}], "keywords": ["K"]}, 5, {"id": "y"}]))
    d = {r.paper_id: r for r in records.dblp_papers(records.read_json_array(spark, str(p))).collect()}
    assert d["dblp:x"].venue == "R" and d["dblp:x"].citations == ["dblp:y"] and d["dblp:x"].fields == ["F", "K"] and d["dblp:x"].citation_count == 4
    work = {"id": "https://openalex.org/W1", "display_name": "D", "publication_year": 2020, "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "referenced_works": ["https://openalex.org/W2"], "authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": "Ann"}}], "primary_location": {"source": {"display_name": "J"}}, "topics": [{"display_name": "T"}], "cited_by_count": 3}
    w = records.openalex_papers(lines(spark, tmp_path, [work])).first()
    assert (w.paper_id, w.abstract, w.venue, w.citations, w.authors[0].author_id) == ("W1", "hello world hello", "J", ["W2"], "A1")
    s = records.scholar_papers(lines(spark, tmp_path, [{"paperId": "p", "venue": "", "publicationVenue": {"name": "PV"}, "citationCount": 2, "s2FieldsOfStudy": [{"category": "CS"}, {"category": "CS"}], "authors": [{"authorId": None, "name": "Z"}]}])).first()
    assert s.venue == "PV" and s.fields == ["CS"] and s.authors[0].author_id == "Z"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_jsonl(spark, str(tmp_path / "none")).count()


def test_seed_file(spark, tmp_path):
    (tmp_path / "s").write_text("# head\nA1 # note\n\n B2\n")
    assert [r.paper_id for r in records.read_seeds(spark, str(tmp_path / "s")).collect()] == ["A1", "B2"]


def test_recorded_service_and_cache():
    r = recorded.Recorded({"a": {"x": 1}, "c": "503", "d": None})
    cached = recorded.Cached(r)
    assert [cached.fetch(k) for k in ("a", "a", "d", "d")] == [{"x": 1}, {"x": 1}, None, None] and (cached.hits, cached.misses, r.served) == (2, 2, 2)
    for _ in range(2):  # a failure is not kept
        with pytest.raises(recorded.FetchFailed):
            cached.fetch("c")
    assert r.served == 4


def test_text_helpers():
    assert slug_of("Café  Über, Ltd.") == "cafe-uber-ltd" and slug_of(None) == ""
    assert parse_json_object('x {"a": 1} y') == {"a": 1} and parse_json_object("```json\n{\"b\": 2}\n```") == {"b": 2}
    assert parse_json_object("[1]") is None and parse_json_object(None) is None


def test_artifacts(tmp_path):
    import numpy as np

    artifact.write(tmp_path / "tree_a.json", {"seed": "a", "x": np.float64(1.5), "s": {"b", "a"}})
    (tmp_path / "ablate_b.json").write_text("{")
    assert artifact.read(tmp_path / "tree_a.json")["s"] == ["a", "b"] and "provenance" in artifact.read(tmp_path / "tree_a.json")
    assert artifact.manifest(tmp_path) == {"runs": [{"file": "tree_a.json", "kind": "tree", "seed": "a"}], "skipped": ["ablate_b.json"]}
    assert "ablate_b.json" in artifact.results_table(tmp_path)
    with pytest.raises(TypeError):
        artifact.plain(object())


def test_config(monkeypatch):
    assert Config().get("ppr.alpha") == 0.15 and Config().get("no.such", 3) == 3
    monkeypatch.setenv("PROVRANK_PPR_ALPHA", "0.3")
    assert Config().section("ppr")["alpha"] == 0.3
    with pytest.raises(KeyError):
        Config().require("nope")


def test_streamed_edges_merge_by_id(spark, tmp_path):
    src = tmp_path / "in"
    schema = "src string, rel string, dst string, weight double"
    for w in (1.0, 2.0):
        spark.createDataFrame([("a", "cites", "b", w), ("a", "cites", f"c{w}", w)], schema).coalesce(1).write.mode("append").json(str(src))
        append_edges(spark.readStream.schema(schema).json(str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.src, r.dst): r.weight for r in merged(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c1.0"): 1.0, ("a", "c2.0"): 2.0}
