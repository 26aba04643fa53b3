"""Clients over a scripted transport and a clock that only counts."""

import json

import pytest

from provrank.operators import expand
from provrank.sources import recorded
from provrank.sources.client import Client, OpenAlex, Policy, Reply, Scholar, record
from provrank.sources.recorded import FetchFailed


class Script:
    """Replies in order, or by path; remembers what was asked."""

    def __init__(self, *replies, by_path=None):
        self.replies, self.by_path, self.asked = list(replies), by_path or {}, []

    def __call__(self, path, params, headers):
        self.asked.append((path, params, headers))
        reply = self.by_path[path] if path in self.by_path else self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


class Counting:
    def __init__(self):
        self.time, self.slept = 0.0, []

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.time += seconds


def ok(payload):
    return Reply(200, json.dumps(payload))


def client(*replies, **options):
    by_path = options.pop("by_path", None)
    options.setdefault("policy", Policy(retries=2, first_wait=1.0, jitter=0.0, per_second=0))
    return Client(Script(*replies, by_path=by_path), clock=Counting(), **options)


def test_answers_and_absences_are_cached_and_failures_are_not():
    c = client(ok({"a": 1}), Reply(404), Reply(400), ok({"b": 2}))
    assert [c.get("x"), c.get("x"), c.get("y"), c.get("y")] == [{"a": 1}, {"a": 1}, None, None]
    with pytest.raises(FetchFailed, match="status 400"):
        c.get("z")
    assert c.get("z") == {"b": 2} and c.stats()["cache_hits"] == 2 and c.stats()["network_calls"] == 4 and c.stats()["failures"] == 1


def test_offline_serves_the_cache_and_raises_for_the_rest():
    c = client(ok([1]))
    c.get("x")
    c.offline = True
    assert c.get("x") == [1]
    with pytest.raises(FetchFailed, match="offline"):
        c.get("y")


@pytest.mark.parametrize("trouble", [Reply(429), Reply(503), ConnectionError("reset")])
def test_passing_trouble_is_retried_and_then_raised(trouble):
    c = client(trouble, ok({}), trouble, trouble, trouble)
    assert c.get("x") == {} and c.clock.slept == [1.0]
    with pytest.raises(FetchFailed, match="after 2 retries"):
        c.get("y")
    assert c.clock.slept == [1.0, 1.0, 2.0] and c.stats() == {"network_calls": 5, "cache_hits": 0, "failures": 1, "waits": 3, "waited_seconds": 4.0}


def test_other_statuses_and_broken_bodies_are_not_retried():
    c = client(Reply(400), Reply(200, "{broken"))
    for path in "xy":
        with pytest.raises(FetchFailed):
            c.get(path)
    assert c.clock.slept == [] and c.stats()["failures"] == 2


def test_retry_after_longest_wait_and_reproducible_jitter():
    c = client(Reply(429, retry_after="7"), Reply(429, retry_after="soon"), ok({}))
    c.get("x")
    assert c.clock.slept == [7.0, 2.0]
    c = client(Reply(429, retry_after="900"), ok({}))
    c.get("x")
    assert c.clock.slept == [60.0]
    slept = []
    for seed in (4, 4, 5):
        c = client(Reply(503), Reply(503), ok({}), policy=Policy(retries=2, first_wait=1.0, per_second=0), seed=seed)
        c.get("x")
        slept.append(c.clock.slept)
    assert slept[0] == slept[1] != slept[2] and all(1 <= s[0] <= 1.1 and 2 <= s[1] <= 2.2 for s in slept)


def test_rate_is_kept():
    c = client(ok(1), ok(2), ok(3), policy=Policy(per_second=4))
    for path in "xyx":
        c.get(path)
    assert c.clock.slept == [0.25]  # the third came from the cache


def test_headers_and_parameters_go_along():
    c = client(ok({"paperId": "p"}), headers={"x-api-key": "k"}, always={"mailto": "a@b.test"})
    Scholar(c).paper("p")
    path, params, headers = c.transport.asked[0]
    assert path == "paper/p" and headers == {"x-api-key": "k"} and params["mailto"] == "a@b.test" and "authors" in params["fields"].split(",") and "." not in params["fields"]


def test_lists_come_out_of_their_envelopes():
    s = Scholar(client(ok({"data": [{"citedPaper": {"paperId": "a"}}, {"citedPaper": None}]}), ok({"data": [{"citingPaper": {"paperId": "b"}}]}), ok({"data": []}), Reply(404)))
    assert s.references("p") == [{"paperId": "a"}] and s.citations("p") == [{"paperId": "b"}] and s.references("q", 5000) == [] and s.citations("q") == []
    assert s.client.transport.asked[2][1]["limit"] == "1000"


def test_ids_are_resolved_in_order():
    work = lambda t: {"id": "https://x.test/W1", "title": t}
    o = OpenAlex(client(Reply(404), ok({"results": [work("By page"), work("Other")]})))
    assert o.work("arXiv:2004.1")[0]["title"] == "By page"
    assert [p for p, _, _ in o.client.transport.asked] == ["works/https://doi.org/10.48550/arXiv.2004.1", "works"]
    o = OpenAlex(client(ok(work("T")), ok(work("T"))))
    assert o.work("10.1/ab") and o.work("W1") and [p for p, _, _ in o.client.transport.asked] == ["works/https://doi.org/10.1/ab", "works/W1"]
    titles = ok({"results": [work("Dense passage retrieval, again"), {"display_name": "Dense  Passage-Retrieval!"}]})
    assert OpenAlex(client(titles)).work("title:dense passage retrieval") == [{"display_name": "Dense  Passage-Retrieval!"}]
    assert OpenAlex(client(ok({"results": [work("Near")]}))).work("title:Nearly") == []


def test_batches_of_fifty_and_a_failed_one():
    replies = [ok({"results": [{"id": "a"}]}), Reply(400), ok({"results": [{"id": "c"}]})]
    o = OpenAlex(client(*replies))
    found, failed = o.batch([f"https://x.test/W{k}" for k in range(120)])
    assert found == [{"id": "a"}, {"id": "c"}] and failed == [f"W{k}" for k in range(50, 100)]
    assert [p["filter"].count("|") + 1 for _, p, _ in o.client.transport.asked] == [50, 50, 20]
    o = OpenAlex(client(ok({"results": []})))
    assert o.citing("https://x.test/W9", 500) == [] and o.client.transport.asked[0][1]["filter"] == "cites:W9" and o.client.transport.asked[0][1]["per-page"] == "200"


def test_what_a_client_fetched_is_built_from(spark, tmp_path):
    paper = lambda p: {"paperId": p, "title": p}
    by_path = {"paper/p": ok(paper("p")), "paper/gone": Reply(404), "paper/p/references": ok({"data": [{"citedPaper": paper("q")}]}), "paper/p/citations": Reply(500)}
    s = Scholar(client(by_path=by_path))
    lines = [record("paper", "p", s.paper), record("paper", "gone", s.paper), record("references", "p", s.references), record("citations", "p", s.citations)]
    (tmp_path / "calls").write_text("\n".join(lines))
    seeds = spark.createDataFrame([(0, "p"), (1, "gone")], "position long, key string")
    built = expand.build_scholar(recorded.read_responses(spark, str(tmp_path / "calls")), seeds, hops=1)
    assert [r.paper_id for r in built.papers.orderBy("seq").collect()] == ["p", "q"] and built.stats["seeds_absent"] == 1
    assert [(r.key, r.call) for r in built.failures.collect()] == [("p", "citations")] and "after 2 retries" in built.failures.first().reason
