"""Fetching from recorded responses: the offline stand-in for paper services, driver-side and cache-first.

A service is anything with fetch(key) -> dict or None. Real clients can be put in its place; executors never call one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FetchFailed(RuntimeError):
    """A response that is neither a record nor a plain absence."""


class Service(Protocol):
    def fetch(self, key: str) -> dict | None: ...


@dataclass
class Recorded:
    """Responses by key; a null response is an absence, a string one an error. Counts what it served."""

    responses: dict[str, dict | str | None]
    served: int = 0

    @classmethod
    def load(cls, path: str | Path) -> Recorded:
        rows = (json.loads(x) for x in Path(path).read_text().splitlines() if x.strip())
        return cls({r["key"]: r["response"] for r in rows})

    def fetch(self, key: str) -> dict | None:
        self.served += 1
        found = self.responses.get(key)
        if isinstance(found, str):
            raise FetchFailed(f"{key}: {found}")
        return found


@dataclass
class Cached:
    """A service behind a cache: absences are kept as absences, failures are not kept."""

    service: Service
    cache: dict[str, dict | None] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def fetch(self, key: str) -> dict | None:
        if key in self.cache:
            self.hits += 1
            return self.cache[key]
        self.misses += 1
        self.cache[key] = found = self.service.fetch(key)
        return found


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls for operators.expand from JSON lines: call, key, and one of records (an array), record or error.

    A line whose records are empty is a call that returned nothing; a line that is no JSON object is dropped.
    """
    from provrank.sources.records import read_jsonl

    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    lines = read_jsonl(spark, path)
    listed = F.coalesce(get("records", "array<variant>"), F.when(get("record", "variant").isNotNull(), F.array(get("record", "variant"))))
    rows = lines.select(get("call").alias("call"), get("key").alias("key"), get("error").alias("error"), F.posexplode_outer(listed).alias("position", "record"))
    return rows.where("call is not null and key is not null").select("call", "key", F.col("position").cast("long").alias("position"), "record", "error")
