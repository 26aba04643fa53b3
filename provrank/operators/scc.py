"""Strongly connected components of a distributed edge list, and cutting cycles inside them.

Nodes without an incoming or an outgoing edge lie on no cycle and are trimmed away. Of the rest each takes as
its colour the greatest node that reaches it; what reaches a colour's own node inside the colour is that
node's component (Orzan, 2004). Found components leave, and the next round goes on with the edges among the rest.

A strongly connected component lies in one weakly connected one. Those with few edges go to a task whole, which finds and
cuts the strong ones inside; the rounds above are left to the others.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.operators.prereq import EDGE
from provrank.operators.prereq import cut_cycles as cut_one
from provrank.storage import materialize, release

#: Edges of a component that one task cuts; a larger one is first made smaller by all tasks.
MAX_EDGES = 200_000


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def trim(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """edges (a, b) less those of nodes on no cycle that come off layer by layer from the sources and the sinks, written."""
    cur, n = edges, edges.count()
    for _ in range(max_rounds):
        inner = cur.select(F.col("a").alias("node")).intersect(cur.select(F.col("b").alias("node")))
        nxt = cur.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(inner.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
        nxt = materialize(nxt, "trimmed")
        release(cur)
        cur, before, n = nxt, n, nxt.count()
        if n == before or not n:
            break
    return cur


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node from which each can be reached, itself included."""
    cur = materialize(_ends(edges).select("node", F.col("node").alias("colour")), "colours")
    while True:
        sent = edges.join(cur.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("got"))
        new = F.greatest("colour", "got")
        nxt = materialize(cur.join(sent, "node", "left").select("node", new.alias("colour"), (new != F.col("colour")).alias("moved")), "colours")
        release(cur)
        cur = nxt.select("node", "colour")
        cur.written_to = nxt.written_to
        if nxt.where("moved").isEmpty():
            return cur


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on a cycle with another node: the greatest node of each strongly connected component.

    edges (a, b) of one orderable type; loops, repeats and nulls don't count. Nodes in no such component have no row.
    """
    cur = materialize(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    found = cur.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while True:
        cur = trim(cur)
        if cur.isEmpty():
            return found
        colours = _colours(cur)
        paint = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = cur.join(paint("a"), "a").join(paint("b"), "b").where("a_colour = b_colour").select("a", "b", F.col("a_colour").alias("colour"))
        same = materialize(same, "same")
        reached = materialize(colours.where("node = colour"), "reached")
        front = reached
        while not front.isEmpty():
            back = same.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = materialize(back.join(reached.select("node"), "node", "left_anti"), "front")
            grown = materialize(reached.unionByName(front), "reached")
            release(reached)
            reached = grown
        size = reached.groupBy("colour").count().where("count > 1").select("colour")
        found = materialize(found.unionByName(reached.join(size, "colour", "left_semi").select("node", F.col("colour").alias("component"))), "found")
        gone = reached.select("node")
        rest = cur.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        rest = materialize(rest, "edges")
        for x in (cur, colours, same):
            release(x)
        cur = rest


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's weakly connected component, by alternating stars (Kiveris et al., 2014)."""
    star = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    cur, told = materialize(edges.where("a != b").select(*star).distinct(), "weak"), None
    while True:
        both = cur.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(cur.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = cur.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        # what is greater than a node goes to its least neighbour, then what is less
        large = both.join(least, "u", "left").where("v > u").select(F.coalesce("m", "u").alias("low"), F.col("v").alias("high")).distinct()
        large = materialize(large, "weak")
        small = large.join(large.groupBy("high").agg(F.min("low").alias("m")), "high")
        nxt = small.select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("low").alias("high")), F.struct(F.col("m").alias("low"), "high"))).alias("e")).select("e.*").where("low != high").distinct()
        nxt = materialize(nxt, "weak")
        release(cur)
        release(large)
        cur, before = nxt, told
        told = cur.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if told == before:
            tops = cur.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            return cur.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(tops)


def strong(pairs: Iterable[tuple[str, str]]) -> dict[str, int]:
    """A number for the strongly connected component of each node of an edge list that fits a task (Tarjan, 1972)."""
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    found: dict[str, int] = {}
    held: list[str] = []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        held.append(start)
        todo = [(start, iter(out[start]))]
        while todo:
            node, rest = todo[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    held.append(nxt)
                    todo.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt not in found:
                    low[node] = min(low[node], index[nxt])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        n = held.pop()
                        found[n] = index[node]
                        if n == node:
                            break
    return found


def cut_cycles(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """edges (prereq, dependent, reason, weight, detail) with dropped: the weakest edge of a cycle goes, until there is none.

    Cycles lie inside strongly connected components, each of which is cut by itself, from its least node. A weakly connected
    component of at most max_edges edges is gathered in one task, which finds the strong ones inside; of a larger one
    only its strong components are gathered.
    """
    live = materialize(edges.where("prereq != dependent").select("prereq", "dependent", "reason", "weight", "detail"), "live")
    where = weak_components(live.select(F.col("prereq").alias("a"), F.col("dependent").alias("b")))
    tagged = materialize(live.join(where.select(F.col("node").alias("prereq"), "component"), "prereq"), "tagged")
    sizes = tagged.groupBy("component").agg(F.count("*").alias("n"))
    big = materialize(sizes.where(F.col("n") > max_edges).select("component"), "big")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = strong(zip(pdf.prereq, pdf.dependent, strict=True))
        ends = pdf.prereq.map(part)
        inner = pdf[ends == pdf.dependent.map(part)]
        done = [cut_one(own) for _, own in inner.drop(columns="component").groupby(ends)]
        done = [own[own["dropped"]].drop(columns="dropped") for own in done]
        return pd.concat(done) if done else pdf.drop(columns="component").iloc[:0]

    small = tagged.join(big, "component", "left_anti").groupBy("component").applyInPandas(run, EDGE)
    if not big.isEmpty():
        small = small.unionByName(_cut_large(tagged.join(big, "component", "left_semi").drop("component"), max_edges))
    cut = materialize(small.select("prereq", "dependent", F.lit(True).alias("dropped")).distinct(), "cut")
    return edges.join(cut, ["prereq", "dependent"], "left").withColumn("dropped", F.coalesce("dropped", F.col("prereq") == F.col("dependent")))


def _cut_large(edges: DataFrame, max_edges: int) -> DataFrame:
    """The edges that cut_cycles() drops, by rounds over all tasks.

    Only strongly connected components meet in a task, each by itself. One with more than max_edges edges first loses
    its weakest edge, which is the weakest of some cycle. Edges between components, and nodes on no cycle, are never gathered.
    """
    live = materialize(edges.select("prereq", "dependent", "reason", "weight", "detail"), "live")
    dropped = live.limit(0)
    while True:
        where = materialize(components(live.select(F.col("prereq").alias("a"), F.col("dependent").alias("b"))), "components")
        side = lambda c: where.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        inner = live.join(side("prereq"), "prereq").join(side("dependent"), "dependent").where("prereq_in = dependent_in").withColumn("component", F.col("prereq_in")).drop("prereq_in", "dependent_in")
        inner = materialize(inner, "inner")
        weakest = inner.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("weight", "prereq", "dependent")).alias("w")).where(F.col("n") > max_edges)
        weakest = materialize(weakest.select("w.prereq", "w.dependent"), "weakest")
        if weakest.isEmpty():
            break
        dropped = materialize(dropped.unionByName(live.join(weakest, ["prereq", "dependent"], "left_semi").select(dropped.columns)), "dropped")
        left = materialize(live.join(weakest, ["prereq", "dependent"], "left_anti").select(live.columns), "live")
        for x in (live, inner, where, weakest):
            release(x)
        live = left

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = cut_one(pdf.drop(columns="component"))
        return done[done["dropped"]].drop(columns="dropped")

    return inner.groupBy("component").applyInPandas(run, EDGE).unionByName(dropped)
