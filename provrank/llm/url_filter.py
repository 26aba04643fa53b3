"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is ``host/path``. It fits its host and all subdomains where the url's path starts with the
rule's path. Of the rules that fit, the longest string wins, of equally long ones that with fewer host
labels; where block and allow name the same rule, block wins. A url that no rule fits gets the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns

#: Rules may be at most this many characters in all: the trie goes to every executor.
MAX_RULE_CHARS = 64_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class RuleTrie:
    """Host labels from the right, then whole path segments; a rule's last, possibly partial segment is a prefix kept at its node.

    A node is [children by host label, path root]; a path node is [children by segment, {prefix: (rule, verdict)}].
    """

    def __init__(self, block: Iterable[str] = (), allow: Iterable[str] = (), default: str = "allow"):
        self.default, self.root = default, [{}, None]
        size = 0
        for verdict, rules in (("allow", allow), ("block", block)):
            for rule in rules:
                host, slash, path = rule.partition("/")
                size += len(rule)
                if not host or not slash:
                    raise ValueError(f"a rule needs a host and a path: {rule!r}")
                if size > MAX_RULE_CHARS:
                    raise ValueError(f"more than {MAX_RULE_CHARS} characters of rules")
                self._add(host.translate(str.maketrans(_UPPER, _UPPER.lower())), path, rule, verdict)

    def _add(self, host: str, path: str, rule: str, verdict: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}]
        at = node[1]
        *whole, last = path.split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, {}])
        at[1][last] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        best, verdict = None, self.default
        if not path.startswith("/"):
            return best, verdict
        segments = path[1:].split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            at = node[1]
            for i, segment in enumerate(segments):
                if at is None:
                    break
                for prefix, (rule, said) in at[1].items():
                    if segment.startswith(prefix) and (best is None or len(rule) > len(best)):
                        best, verdict = rule, said
                at = at[0].get(segment) if i + 1 < len(segments) else None
        return best, verdict


def judge(df: DataFrame, trie: RuleTrie, url_col: str = "url") -> DataFrame:
    """df with host, path, rule and verdict. Columns of df with those names give way.

    A null url, one without ``://`` and an empty one have empty host and path, no rule and the
    default verdict; repeated rows are each judged; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    parts = add_columns(df, {"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    parts = parts.withColumn("__hit", look_up("host", "path"))
    return add_columns(parts, {"rule": F.col("__hit.rule"), "verdict": F.col("__hit.verdict")}).drop("__hit")
