"""Strongly connected components and cycle cutting against plain versions."""

import random

import pandas as pd
import pytest

from provrank.operators import prereq, scc
from provrank.plans.queries import QUERIES


def plain_components(edges):
    """{node: greatest node of its component} by reachability both ways, components of two nodes or more."""
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(start, links):
        seen, todo = {start}, [start]
        while todo:
            for n in links.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    found = {}
    for n in {x for e in edges for x in e}:
        if n not in found:
            own = reach(n, out) & reach(n, back)
            found |= dict.fromkeys(own, max(own))
    return {n: c for n, c in found.items() if list(found.values()).count(c) > 1}


def plain_cut(rows):
    """Dropped (prereq, dependent) by the one-task version in each component."""
    where = plain_components([r[:2] for r in rows if r[0] != r[1]])
    gone = {r[:2] for r in rows if r[0] == r[1]}
    for c in set(where.values()):
        own = [r for r in rows if r[0] != r[1] and where.get(r[0]) == where.get(r[1]) == c]
        done = prereq.cut_cycles(pd.DataFrame(own, columns=["prereq", "dependent", "weight"]))
        gone |= {(r.prereq, r.dependent) for r in done.itertuples() if r.dropped}
    return gone


def acyclic(edges):
    left = set(edges)
    while ends := {e for e in left if e[1] not in {a for a, _ in left}}:
        left -= ends
    return not left


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "citation", float(w), "") for a, b, w in rows], prereq.EDGE)


@pytest.mark.parametrize("nodes, degree", [(12, 2.0), (30, 1.2)])
def test_components_of_random_graphs(spark, nodes, degree):
    rng = random.Random(nodes)
    edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * degree))}
    rows = [*edges, *list(edges)[:3], (None, 1), (2, None)]
    got = {r.node: r.component for r in scc.components(spark.createDataFrame(rows, "a int, b int")).collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


def test_a_long_chain_is_trimmed_and_a_ring_behind_it_found(spark):
    rows = [(k, k + 1) for k in range(12)] + [(12, 10)] + [(20, 21), (21, 20), (12, 20), (21, 30)]
    got = {r.node: r.component for r in scc.components(spark.createDataFrame(rows, "a int, b int")).collect()}
    assert got == {10: 12, 11: 12, 12: 12, 20: 21, 21: 21}
    assert scc.components(spark.createDataFrame([], "a int, b int")).collect() == []
    left = {tuple(r) for r in scc.trim(spark.createDataFrame(rows, "a int, b int")).collect()}
    assert left == {(10, 11), (11, 12), (12, 10), (12, 20), (20, 21), (21, 20)}


@pytest.mark.parametrize("max_edges", [scc.MAX_EDGES, 6])
def test_cut_cycles(spark, max_edges):
    rng = random.Random(8)
    rows = list({(f"n{a}", f"n{b}"): (f"n{a}", f"n{b}", rng.randint(1, 9)) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(26))}.values())
    got = {(r.prereq, r.dependent): r.dropped for r in scc.cut_cycles(frame(spark, rows), max_edges).collect()}
    assert set(got) == {r[:2] for r in rows}
    gone = {e for e, d in got.items() if d}
    assert gone and acyclic(set(got) - gone)
    if max_edges > 6:
        assert gone == plain_cut(rows)
    where = plain_components([r[:2] for r in rows if r[0] != r[1]])
    assert all(a == b or where.get(a, a) == where.get(b, b) for a, b in gone)  # only edges on a cycle


def test_whole_table(spark, small):
    rows = QUERIES["cycles_cut"](spark, small).collect()
    assert {(r.prereq, r.dependent) for r in rows if r.dropped} == plain_cut([(r.prereq, r.dependent, r.weight) for r in rows])
    assert acyclic({(r.prereq, r.dependent) for r in rows if not r.dropped}) and len(rows) > 100


def cut_from_the_start(rows):
    """Dropped edges where each search for a cycle begins anew at the least node."""
    weight, gone = {(a, b): w for a, b, w in rows}, set()
    while True:
        out, ring, done = {}, None, set()
        for a, b in sorted(set(weight) - gone):
            out.setdefault(a, []).append(b)

        def walk(path):
            nonlocal ring
            for n in out.get(path[-1], ()):
                if ring is None and n in path:
                    ring = [*path[path.index(n) :], n]
                elif ring is None and n not in done:
                    walk([*path, n])
            done.add(path[-1])

        for start in out:
            if ring is None and start not in done:
                walk([start])
        if ring is None:
            return gone
        gone.add(min(zip(ring, ring[1:], strict=False), key=lambda e: (weight[e], e)))


def test_going_on_after_a_cut_drops_what_a_search_from_the_start_drops():
    for seed in range(40):
        rng = random.Random(seed)
        rows = list({(a, b): (a, b, rng.randint(1, 4)) for a, b in ((f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(rng.randint(8, 50)))}.values())
        done = prereq.cut_cycles(pd.DataFrame(rows, columns=["prereq", "dependent", "weight"]))
        assert {(r.prereq, r.dependent) for r in done.itertuples() if r.dropped} == cut_from_the_start(rows)


def test_a_dense_component_is_cut_in_one_search():
    import time

    rng = random.Random(3)
    rows = [(f"n{a:04}", f"n{b:04}", rng.random()) for a, b in {(rng.randrange(3000), rng.randrange(3000)) for _ in range(6500)} if a != b]
    began = time.process_time()
    done = prereq.cut_cycles(pd.DataFrame(rows, columns=["prereq", "dependent", "weight"]))
    assert time.process_time() - began < 2  # 0.1 s; anew for each cycle 5.2 s
    left = [(r.prereq, r.dependent) for r in done.itertuples() if not r.dropped]
    assert len(set(scc.strong(left).values())) == len({n for e in left for n in e})  # no component of two nodes


def test_strong_and_weak_components(spark):
    for nodes, degree in ((12, 2.0), (40, 1.1), (40, 0.7)):
        rng = random.Random(nodes)
        edges = [(a, b) for a, b in {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * degree))} if a != b]
        part, plain = scc.strong(edges), plain_components(edges)
        assert {frozenset(n for n in part if part[n] == c) for c in part.values()} - {frozenset([n]) for n in part} == {frozenset(n for n in plain if plain[n] == c) for c in plain.values()}
        weak = {r.node: r.component for r in scc.weak_components(spark.createDataFrame(edges, "a int, b int")).collect()}
        label = {n: n for e in edges for n in e}
        for _ in range(nodes):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert weak == label
