"""Typed paths between pairs of papers, and claims grounded in them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provrank.storage import materialize

#: Path types, strongest first.
TYPES = ("direct_citation", "co_citation", "shared_author", "shared_concept", "shared_venue")
_SHARED = {"authored_by": ("shared_author", "both linked to "), "shares_concept": ("shared_concept", "both linked to "), "published_in": ("shared_venue", "both linked to "), "cites": ("co_citation", "both cite "), "cited_by": ("co_citation", "both cited by ")}


#: Arcs of a paper that one row lists; pairs with a paper of more are joined arc by arc.
MAX_LIST = 256
_RELS = tuple(_SHARED)


def _first(forward: Column, backward: Column, shared: Column, max_paths: int, names: tuple[Column, Column]) -> Column:
    """The first max_paths of a pair's paths, as an array of (kind, via, turn, edge_ids): by type, via and detail."""
    said = [F.concat(names[i], F.lit(" cites "), names[1 - i]) for i in (0, 1)]
    ahead = F.when(said[0] <= said[1], 0).otherwise(1)
    direct = lambda arcs, turn: F.transform(arcs, lambda x: F.struct(F.lit(1).alias("kind"), F.nullif(x["via"], x["via"]).alias("via"), turn.alias("turn"), F.lit(0).alias("rel"), F.array(x["e"]).alias("edge_ids")))
    every = F.concat(direct(forward, ahead), F.transform(direct(backward, 1 - ahead), lambda x: F.struct(x["kind"].alias("kind"), x["via"].alias("via"), x["turn"].alias("turn"), F.lit(1).alias("rel"), x["edge_ids"].alias("edge_ids"))), shared)
    return F.slice(F.array_sort(every), 1, max_paths)


def paths(pairs: DataFrame, arcs: DataFrame, nodes: DataFrame, max_paths: int = 12, label: Callable[[Column], Column] | None = None, max_list: int = MAX_LIST) -> DataFrame:
    """(seed, candidate, position, relation, via, detail, edge_ids) for each pair, at most max_paths, strongest type first, then via, then detail.

    Both ends must be nodes, which the arcs' ends are. Each paper's arcs are one list; a pair's two lists meet in one
    row, so only what both ends share is ever a row of its own. Pairs with a paper of more than max_list arcs are
    joined on (pair, relation, neighbour) instead. label gives a node's label where its id tells it.
    """
    code = F.array_position(F.array(*map(F.lit, _RELS)), F.col("rel")).cast("int")
    mine = arcs.where(F.col("rel").isin(*_RELS)).select("src", code.alias("rel"), F.col("dst").alias("via"), F.col("edge_id").alias("e"))
    large = materialize(mine.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > max_list).select("src"), "large")
    pairs = pairs.select("seed", "candidate").distinct()
    name = lambda col, out: nodes.select(F.col("node_id").alias(col), F.coalesce("label", "node_id").alias(out))
    if label is None:
        pairs = pairs.join(name("seed", "seed_label"), "seed").join(name("candidate", "candidate_label"), "candidate")
        names = (F.col("seed_label"), F.col("candidate_label"))
    else:
        names = (label(F.col("seed")), label(F.col("candidate")))
    kind = lambda rel: F.array_position(F.array(*map(F.lit, TYPES)), F.element_at(F.array(*[F.lit(t) for t, _ in _SHARED.values()]), rel)).cast("int")
    entry = lambda rel, via, a, b: F.struct(kind(rel).alias("kind"), via.alias("via"), F.when(rel == _RELS.index("cited_by") + 1, 1).otherwise(0).alias("turn"), rel.alias("rel"), F.array(a, b).alias("edge_ids"))
    cites = _RELS.index("cites") + 1
    hubs = not large.isEmpty()
    few = mine.join(large, "src", "left_anti") if hubs else mine
    listed = few.groupBy("src").agg(F.collect_list(F.struct("rel", "via", "e")).alias("xs"))
    side = lambda df, c: df.select(F.col("src").alias(c), F.col("xs").alias(f"{c}_xs"))
    both = pairs.join(side(listed, "seed"), "seed", "left").join(side(listed, "candidate"), "candidate", "left")
    none = F.array().cast(listed.schema["xs"].dataType)
    s, c = F.coalesce("seed_xs", none), F.coalesce("candidate_xs", none)
    alike = F.flatten(F.transform(s, lambda x: F.transform(F.filter(c, lambda y: (y["via"] == x["via"]) & (y["rel"] == x["rel"])), lambda y: entry(x["rel"], x["via"], x["e"], y["e"]))))
    to = lambda xs, end: F.filter(xs, lambda x: (x["via"] == F.col(end)) & (x["rel"] == cites))
    if not hubs:
        found = both.select(*pairs.columns, _first(to(s, "candidate"), to(c, "seed"), alike, max_paths, names).alias("found"))
    else:
        of = large.withColumn("wide", F.lit(True))
        marked = pairs.join(of.withColumnRenamed("src", "seed").withColumnRenamed("wide", "sw"), "seed", "left").join(of.withColumnRenamed("src", "candidate").withColumnRenamed("wide", "cw"), "candidate", "left")
        marked = materialize(marked.withColumn("wide", F.coalesce("sw", "cw", F.lit(False))).drop("sw", "cw"), "pairs")
        some = marked.where("not wide").drop("wide")
        both = some.join(side(listed, "seed"), "seed", "left").join(side(listed, "candidate"), "candidate", "left")
        found = both.select(*pairs.columns, _first(to(s, "candidate"), to(c, "seed"), alike, max_paths, names).alias("found"))
        rest = marked.where("wide").drop("wide")
        arc = lambda end, e: mine.select(F.col("src").alias(end), "rel", "via", F.col("e").alias(e))
        met = rest.join(arc("seed", "se"), "seed").join(rest.select("seed", "candidate").join(arc("candidate", "ce"), "candidate"), ["seed", "candidate", "rel", "via"])
        said = [F.concat(names[i], F.lit(" cites "), names[1 - i]) for i in (0, 1)]
        ahead = F.when(said[0] <= said[1], 0).otherwise(1)
        one = lambda end, other, turn, rel: rest.join(arc(end, "e").where(F.col("rel") == cites).select(end, F.col("via").alias(other), "e"), ["seed", "candidate"]).select(*pairs.columns, F.struct(F.lit(1).alias("kind"), F.nullif(other, other).alias("via"), turn.alias("turn"), F.lit(rel).alias("rel"), F.array("e").alias("edge_ids")).alias("x"))
        rows = met.select(*pairs.columns, entry(F.col("rel"), F.col("via"), F.col("se"), F.col("ce")).alias("x")).unionByName(one("seed", "candidate", ahead, 0)).unionByName(one("candidate", "seed", 1 - ahead, 1))
        w = Window.partitionBy("seed", "candidate").orderBy("x")
        top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_paths)
        found = found.unionByName(top.groupBy(*pairs.columns).agg(F.array_sort(F.collect_list("x")).alias("found")))
    out = found.select(*pairs.columns, F.posexplode("found").alias("at", "x")).select(*pairs.columns, (F.col("at") + 1).alias("position"), "x.*")
    if label is None:
        out = out.join(name("via", "via_label"), "via", "left")
        shown = F.coalesce("via_label", "via")
    else:
        shown = label(F.col("via"))
    words = F.get(F.array(*[F.lit(t) for _, t in _SHARED.values()]), F.col("rel") - 1)
    said = F.when(F.col("kind") > 1, F.concat(words, shown)).when(F.col("rel") == 0, F.concat(names[0], F.lit(" cites "), names[1])).otherwise(F.concat(names[1], F.lit(" cites "), names[0]))
    return out.select("seed", "candidate", "position", F.element_at(F.array(*map(F.lit, TYPES)), F.col("kind")).alias("relation"), "via", said.alias("detail"), "edge_ids")


def explain(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(seed, candidate, text, cited_edges, path_count): the deterministic explanation; edge ids in path order, first seen."""
    ordered = found.groupBy("seed", "candidate").agg(F.array_sort(F.collect_list(F.struct("position", "relation", "detail", "edge_ids"))).alias("p"))
    said = F.concat(F.lit("Links in the graph: "), F.array_join(F.transform("p", lambda x: F.concat(F.replace(x["relation"], F.lit("_"), F.lit(" ")), F.lit(" ("), x["detail"], F.lit(")"))), "; "), F.lit("."))
    out = pairs.select("seed", "candidate").distinct().join(ordered, ["seed", "candidate"], "left")
    none = F.lit("The graph holds no typed path for this pair.")
    return out.select("seed", "candidate", F.coalesce(said, none).alias("text"), F.coalesce(F.array_distinct(F.flatten(F.transform("p", lambda x: x["edge_ids"]))), F.array().cast("array<string>")).alias("cited_edges"), F.coalesce(F.size("p"), F.lit(0)).alias("path_count"))


def ground_claims(claims: DataFrame, found: DataFrame) -> DataFrame:
    """claims (seed, candidate, claim_no, relation) with their edges, by type; reason says why a claim has none."""
    by_type = found.groupBy("seed", "candidate", "relation").agg(F.array_sort(F.collect_list(F.struct("position", "edge_ids"))).alias("p"))
    out = claims.join(by_type, ["seed", "candidate", "relation"], "left")
    reason = F.when(F.col("p").isNotNull(), F.lit(None).cast("string")).when(F.col("relation").isin(*TYPES), F.lit("the graph has no such connection")).otherwise(F.lit("unknown relation type"))
    return out.select("seed", "candidate", "claim_no", "relation", F.coalesce(F.array_distinct(F.flatten(F.transform("p", lambda x: x["edge_ids"]))), F.array().cast("array<string>")).alias("edge_ids"), reason.alias("reason"))


def ground_facts(replies: DataFrame, found: DataFrame) -> DataFrame:
    """replies (seed, candidate, fact_numbers array<string>) to the edges of the paths with those positions.

    Numbers out of range and values that are no numbers are counted; a reply without numbers cites nothing.
    """
    number = F.explode_outer("fact_numbers").alias("raw")
    rows = replies.select("seed", "candidate", number).withColumn("position", F.expr("try_cast(raw as int)"))
    hit = rows.select("seed", "candidate", "raw", "position").join(found.select("seed", "candidate", "position", "edge_ids"), ["seed", "candidate", "position"], "left")
    used = F.array_sort(F.collect_set(F.when(F.col("edge_ids").isNotNull(), F.struct("position", "edge_ids"))))
    out = hit.groupBy("seed", "candidate").agg(used.alias("u"), F.countDistinct(F.when(F.col("position").isNotNull() & F.col("edge_ids").isNull(), F.col("position"))).alias("out_of_range"), F.sum(F.when(F.col("raw").isNotNull() & F.col("position").isNull(), 1).otherwise(0)).alias("unparseable"))
    return out.select("seed", "candidate", F.array_distinct(F.flatten(F.transform("u", lambda x: x["edge_ids"]))).alias("cited_edges"), F.size("u").alias("facts_used"), "out_of_range", "unparseable")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
