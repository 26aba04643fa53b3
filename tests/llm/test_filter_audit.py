"""Filter audit against applying every order to the documents one by one, and against SQL."""

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

from provrank.llm import filter_audit as fa
from provrank.llm.queries import oracle_sql, op13_filter_audit


def brute(docs, labels):
    """Rows by filtering the documents themselves for each order."""
    least, marks = {}, defaultdict(lambda: [0, 0])
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and least[t] < i}
        rows.append((s or "", {f for f, bad in fails.items() if bad}, *(marks[i] if i is not None else (0, 0))))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            total = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in total if f in r[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in total), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in fa.transpositions(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == sum(1 for _ in fa.transpositions(n)) + 1


def test_a_swap_computes_two_steps():
    rng = np.random.default_rng(1)
    walk = fa.Walk(rng.integers(0, 9, (3, 32, 3)))
    assert sum(1 for _ in walk.orders()) == 120 and walk.updates == 5 + 2 * 119
    assert (walk.shapley.sum(axis=1) == 120 * (walk.passing[:, 0, 0] - walk.passing[:, 31, 0])).all()


def test_given_table_equals_sql(spark, small):
    got = op13_filter_audit(spark, small).toPandas()
    documents, labels = (pd.read_parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))  # noqa: F841
    want = duckdb.sql(oracle_sql()["op13_filter_audit"]).df()
    keys = ["part", "filter_order", "step"]
    assert got.sort_values(keys)[list(want.columns)].values.tolist() == want.sort_values(keys).values.tolist()


def test_brute_force_with_nulls_ties_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", "short", "SHOUT $", long, long, long.upper(), f"{long} #", "a b " * 40, "a b " * 60, f"{long}\x1c", "é" * 30, long * 300]
    docs = [(k % 40 if k % 11 else None, texts[k % len(texts)], (None, "", "s1", "s2")[k % 4]) for k in range(200)]
    docs += docs[:5]
    labels = [(k, k % 3 == 0 or None, k % 2) for k in range(0, 40, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = [(i, None if q is None else int(q), x) for i, q, x in labels]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, quality int, part string, Mask int").repartition(5)
    marks = spark.createDataFrame([(*m, "y") for m in labels], "doc_id long, quality int, toxic int, text string")
    assert as_dict(fa.audit(df, marks)) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs.limit(0), labels).collect() == []
    assert as_dict(fa.audit(docs, labels)) == brute([(1, "x", "s")], [])
