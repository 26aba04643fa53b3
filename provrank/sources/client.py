"""Clients of paper services: driver-side, cache-first, with retries, waits and a rate that an injected clock times.

A call ends in one of three ways: a payload, a confirmed absence (None, kept in the cache as such), or
FetchFailed. Nothing else is an absence, so a refusal can't pass for an empty list. Executors call no
service: what a client fetched is recorded (record()) and read by sources.recorded.read_responses.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator, MutableMapping
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from provrank.sources.recorded import FetchFailed

#: Statuses that a later try may not meet again, and ids that one batch call may name.
PASSING = (429, 500, 502, 503, 504)
BATCH = 50
#: The fields asked of each service; author ids and names come with "authors" whole.
PAPER_FIELDS = "paperId,corpusId,title,abstract,year,venue,publicationVenue,citationCount,referenceCount,s2FieldsOfStudy,authors"
WORK_FIELDS = "id,title,display_name,publication_year,abstract_inverted_index,cited_by_count,referenced_works,authorships,primary_location,topics"


@dataclass(frozen=True)
class Reply:
    """What a transport brings back: a status, the body's text, and the Retry-After header if there was one."""

    status: int
    body: str = ""
    retry_after: str | None = None


#: (path, params, headers) -> Reply; an OSError stands for a failed connection.
Transport = Callable[[str, dict[str, str], dict[str, str]], Reply]


class Clock(Protocol):
    def now(self) -> float: ...
    def sleep(self, seconds: float) -> None: ...


class SystemClock:
    now = staticmethod(time.monotonic)
    sleep = staticmethod(time.sleep)


@dataclass
class Counters:
    network_calls: int = 0
    cache_hits: int = 0
    failures: int = 0
    waits: int = 0
    waited_seconds: float = 0.0


@dataclass(frozen=True)
class Policy:
    """How often and how patiently to try: waits double from first_wait to longest_wait unless the service names one; jitter is a share of a wait."""

    retries: int = 5
    first_wait: float = 2.0
    longest_wait: float = 60.0
    jitter: float = 0.1
    per_second: float = 5.0


@dataclass
class Client:
    """GET with a cache in front; offline answers from the cache alone and raises for the rest."""

    transport: Transport
    name: str = ""
    cache: MutableMapping[str, str | None] = field(default_factory=dict)
    policy: Policy = field(default_factory=Policy)
    clock: Clock = field(default_factory=SystemClock)
    headers: dict[str, str] = field(default_factory=dict)
    always: dict[str, str] = field(default_factory=dict)
    offline: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        self.counters = Counters()
        self._chance = random.Random(self.seed)
        self._free_at = float("-inf")

    def get(self, path: str, **params: Any) -> Any | None:
        """The payload of a path, or None for a confirmed absence."""
        asked = {k: str(v) for k, v in (self.always | params).items()}
        key = json.dumps([self.name, path, sorted(asked.items())])
        if key in self.cache:
            self.counters.cache_hits += 1
            return _payload(self.cache[key])
        if self.offline:
            raise FetchFailed(f"offline, and {path} is not in the cache")
        try:
            body = self._fetch(path, asked)
        except FetchFailed:
            self.counters.failures += 1
            raise
        self.cache[key] = body
        return _payload(body)

    def _fetch(self, path: str, params: dict[str, str]) -> str | None:
        waits = self._waits()
        while True:
            self._keep_rate()
            self.counters.network_calls += 1
            named = None
            try:
                reply = self.transport(path, params, self.headers)
            except OSError as e:
                trouble = f"no connection: {e}"
            else:
                if reply.status == 404:
                    return None
                if reply.status == 200:
                    if _payload(reply.body, broken=True) is _BROKEN:
                        raise FetchFailed(f"{path}: the body is no JSON")
                    return reply.body
                trouble, named = f"status {reply.status}", reply.retry_after
                if reply.status not in PASSING:
                    raise FetchFailed(f"{path}: {trouble}")
            wait = next(waits, None)
            if wait is None:
                raise FetchFailed(f"{path}: {trouble} after {self.policy.retries} retries")
            self._rest(_seconds(named, wait))

    def _waits(self) -> Iterator[float]:
        wait = self.policy.first_wait
        for _ in range(self.policy.retries):
            yield wait
            wait *= 2

    def _rest(self, wait: float) -> None:
        wait = min(wait, self.policy.longest_wait)
        wait += wait * self.policy.jitter * self._chance.random()
        self.counters.waits += 1
        self.counters.waited_seconds += wait
        self.clock.sleep(wait)

    def _keep_rate(self) -> None:
        if self.policy.per_second <= 0:
            return
        early = self._free_at - self.clock.now()
        if early > 0:
            self.clock.sleep(early)
        self._free_at = self.clock.now() + 1 / self.policy.per_second

    def stats(self) -> dict:
        return asdict(self.counters)


_BROKEN = object()


def _payload(body: str | None, broken: bool = False) -> Any:
    try:
        return None if body is None else json.loads(body)
    except ValueError:
        if broken:
            return _BROKEN
        raise


def _seconds(named: str | None, otherwise: float) -> float:
    """A Retry-After in seconds; dates and nonsense count as not given."""
    return float(named) if named and re.fullmatch(r"\s*\d+(\.\d+)?\s*", named) else otherwise


@dataclass
class Scholar:
    """The calls of a graph service: single papers, and lists that hold each paper in an envelope."""

    client: Client

    def paper(self, key: str) -> list[dict]:
        found = self.client.get(f"paper/{key}", fields=PAPER_FIELDS)
        return [found] if found else []

    def references(self, key: str, limit: int = 60) -> list[dict]:
        return self._listed(key, "references", "citedPaper", limit)

    def citations(self, key: str, limit: int = 60) -> list[dict]:
        return self._listed(key, "citations", "citingPaper", limit)

    def search(self, text: str, limit: int = 20) -> list[dict]:
        return (self.client.get("paper/search", query=text, limit=limit, fields=PAPER_FIELDS) or {}).get("data") or []

    def _listed(self, key: str, what: str, envelope: str, limit: int) -> list[dict]:
        found = self.client.get(f"paper/{key}/{what}", fields=PAPER_FIELDS, limit=min(limit, 1000)) or {}
        return [x[envelope] for x in found.get("data") or [] if x.get(envelope)]


@dataclass
class OpenAlex:
    """The calls of a works service; ids may be works', DOIs, ``arxiv:`` and ``title:`` with an exact title."""

    client: Client

    def work(self, key: str) -> list[dict]:
        """An arXiv id is tried by its DOI, then by its landing page; a title only where its letters and digits are the same."""
        kind, _, rest = key.strip().partition(":")
        if kind.lower() == "title":
            same = _letters(rest)
            return [w for w in self._works(filter=f"title.search:{rest.strip()}", per_page=25) if _letters(w.get("title") or w.get("display_name") or "") == same][:1]
        if kind.lower() == "arxiv":
            found = self._one(f"https://doi.org/10.48550/arXiv.{rest}")
            return found or self._works(filter=f"locations.landing_page_url.search:{rest}", per_page=5)[:1]
        return self._one(f"https://doi.org/{key.strip()}" if key.strip().startswith("10.") else key.strip())

    def batch(self, keys: Iterable[str]) -> tuple[list[dict], list[str]]:
        """Works by id, BATCH a call, and the ids of calls that failed."""
        ids, found, failed = [k.rsplit("/", 1)[-1] for k in keys if k], [], []
        for at in range(0, len(ids), BATCH):
            some = ids[at : at + BATCH]
            try:
                found += self._works(filter=f"openalex_id:{'|'.join(some)}", per_page=len(some))
            except FetchFailed:
                failed += some
        return found, failed

    def citing(self, key: str, limit: int = 25) -> list[dict]:
        return self._works(filter=f"cites:{key.rsplit('/', 1)[-1]}", per_page=min(limit, 200), sort="cited_by_count:desc")

    def search(self, text: str, limit: int = 20) -> list[dict]:
        return self._works(search=text, per_page=min(limit, 200))

    def _one(self, path: str) -> list[dict]:
        found = self.client.get(f"works/{path}", select=WORK_FIELDS)
        return [found] if found else []

    def _works(self, per_page: int, **params: str) -> list[dict]:
        return (self.client.get("works", **params, **{"per-page": per_page, "select": WORK_FIELDS}) or {}).get("results") or []


def _letters(title: str) -> str:
    return "".join(c for c in title.lower() if c.isalnum())


def record(call: str, key: str, fetch: Callable[[str], list[dict]]) -> str:
    """One call as a line of recorded responses; a failed one holds its error, an absence no records."""
    try:
        return json.dumps({"call": call, "key": key, "records": fetch(key)}, ensure_ascii=False)
    except FetchFailed as e:
        return json.dumps({"call": call, "key": key, "error": str(e)}, ensure_ascii=False)
