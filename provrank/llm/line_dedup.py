"""Line dedup by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages; a line above ``ratio``
on at least ``min_pages`` pages is boilerplate there and is dropped from that host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import materialize


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(df: DataFrame, ratio: float = 0.1, min_pages: int = 3, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines. A host has at most its mean number of lines over ratio of them."""
    base = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    pages = base.groupBy("host").agg(F.count("*").alias("pages"))
    lines = base.select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _key))).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    p = pages.select(F.col("host").alias("of"), "pages")
    seen = seen.join(p, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages")).select("host", "line")
    return seen.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_lines(df: DataFrame, ratio: float = 0.1, min_pages: int = 3, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """df with its text less the boilerplate lines of its host, n_lines and n_dropped.

    Lines are what ``\\n`` divides. Blank lines are never counted or dropped. Pages count each line
    once; repeated rows are pages of their own. A null host is a host of its own. A null text stays
    null with no lines; an empty text stays empty. Columns named n_lines or n_dropped give way.
    """
    found = materialize(boilerplate(df, ratio, min_pages, text_col, host_col).select(F.col("host").alias("__host"), F.col("lines").alias("__bad")), "boilerplate")
    out = df.join(found, F.col(f"`{host_col}`").eqNullSafe(F.col("__host")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__bad"), _key(x))))
    out = out.withColumn("__kept", kept)
    new = {
        text_col: F.when(F.col("__bad").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join("__kept", "\n")),
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long"),
    }
    cols = [new.pop(c).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*cols, *[v.alias(k) for k, v in new.items()])
