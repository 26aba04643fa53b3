"""Scalar functions on text and records, as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def document_text(title: Column, abstract: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))


def normal_title(title: Column) -> Column:
    """Letters and digits only, lower case, for exact title matches."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]", "")


def slug_of(text: str | None, limit: int = 80) -> str:
    ascii_ = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", "-", re.sub(r"[^a-z0-9 -]", " ", ascii_).strip())[:limit]


def slugify(text: Column) -> Column:
    """NFKD to ASCII, lower, other characters to spaces, runs of spaces to hyphens. Spark has no normalize(), hence Arrow."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(slug_of, na_action=None)

    return of(text)


def rebuild_abstract(index: Column) -> Column:
    """The text of a map from token to positions, ordered by position, then token; '' for null."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["t"]), " "), F.lit(""))


def short_id(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def parse_json_object(text: str | None) -> dict | None:
    """The first JSON object that stands whole in a text, whatever is around it: prose, a fence, brackets."""
    text, decoder = text or "", json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_object(text: Column) -> Column:
    """parse_json_object() as a column of JSON text; null where there is none."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (o := parse_json_object(t)) is None else json.dumps(o, sort_keys=True), na_action=None)

    return of(text)


def verdict_note(testable: Column, faithful: Column, displacement: Column) -> Column:
    return F.when(~testable, "not testable").when(faithful, "removing the cited edges moves it further than chance").when(displacement > 0, "moves, but no further than random edges").otherwise("does not move")
