import random

from provrank.llm.decontam import BlockMaxIndex, annotate, contaminated, keep_clean, split_item


def items(n=60, seed=1):
    r = random.Random(seed)
    v = [f"t{i}" for i in range(400)] + ["the", "of", "and"] * 20
    return [(i, " ".join(r.choice(v) for _ in range(r.randint(8, 40))) + ". " + " ".join(r.choice(v) for _ in range(5)) + ".") for i in range(n)]


def test_wand_equals_full_scoring():
    import numpy as np

    index = BlockMaxIndex(items())
    r = random.Random(2)
    for _ in range(300):
        ids = np.array(sorted(r.sample(range(len(index.term)), r.randint(1, 120))), dtype=np.int32)
        full = {}
        for j in ids:
            for d, v in zip(index.docs[j], index.impacts[j]):
                full[d] = full.get(d, 0) + v
        for t in (0.05, 0.2, 0.5):
            got = dict(index.retrieve(ids, t))
            assert set(got) == {d for d, v in full.items() if v >= t - 1e-12} or all(abs(full[d] - t) < 1e-6 for d in set(got) ^ {d for d, v in full.items() if v >= t})


def test_items_are_found_anywhere(spark):
    bench = items()
    r = random.Random(3)
    rows, want = [], set()
    for i in range(80):
        words = [f"clean{r.randint(0, 5000)}" for _ in range(r.randint(0, 900))]
        if i % 2:
            k = r.randrange(len(bench))
            words.insert(r.randint(0, len(words)), bench[k][1].upper())
            want.add((i, k))
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "the of and " * 3000)]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, Hits array<int>")
    b = spark.createDataFrame([*bench, (99, None), (98, "..."), (5, bench[5][1])], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(docs, b).collect()}
    assert got == want
    clean = keep_clean(docs, b)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in want})
    assert annotate(docs, b.limit(0)).where("size(hits) > 0").count() == 0
    assert contaminated(docs.limit(0), b).count() == 0


def test_question_and_answer():
    assert split_item("A b c. D e.") == (["a", "b", "c"], ["d", "e"])
    q, a = split_item("one two three four five six seven eight")
    assert q + a == "one two three four five six seven eight".split() and len(a) == 2
    assert split_item("") == ([], []) and split_item("word") == (["word"], [])


def test_scores_are_the_same_however_the_benchmark_is_cut(spark, monkeypatch):
    from provrank.llm import decontam

    bench = items(50)
    texts = [" ".join(w for k, w in enumerate(t.split()) if k % 4) for _, t in bench]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    find = lambda: sorted(tuple(r) for r in contaminated(docs, table, threshold=0.3, question=0.1, answer=0.0).collect())
    whole = find()
    monkeypatch.setattr(decontam, "SHARD", 7)
    assert find() == whole and len(whole) >= 50


def test_more_items_than_a_group_of_indexes_score_as_one_benchmark(spark, monkeypatch):
    """Every document against every item by the plain formula, with string ids, nulls and an id column that clashes."""
    import math
    import random
    from collections import Counter

    from provrank.llm import decontam

    monkeypatch.setattr(decontam, "SHARD", 300)
    monkeypatch.setattr(decontam, "GROUP", 2)
    r = random.Random(9)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)]
    items = [(f"i{k:05d}", " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 20)))) for k in range(1100)]
    docs = []
    for k in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 90))]
        got = r.choice(items)[1].split()
        docs.append((k, " ".join(w[:10] + got[: r.randint(3, len(got))] + w[10:])))
    docs += [(200, None), (201, ""), (202, "!!"), (203, docs[0][1]), (203, docs[0][1])]
    words = {i: t.split() for i, t in items}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    weight = {}
    for i, w in words.items():
        raw = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in Counter(w).items()}
        weight[i] = {t: v / sum(raw.values()) for t, v in raw.items()}
    want = set()
    for d, text in set(docs):
        have = set((text or "").split())
        want |= {(d, i) for i, w in weight.items() if sum(v for t, v in w.items() if t in have) >= 0.5}
    table = spark.createDataFrame(docs, "score long, text string")
    found = decontam.contaminated(table, spark.createDataFrame([*items, (None, "w1 w2"), ("x", None)], "item_id string, text string"), id_col="score", question=0.0, answer=0.0).collect()
    assert {(x.doc_score, x.item_id) for x in found} == want and len(want) > 60
    assert decontam.keep_clean(table, spark.createDataFrame(items, "item_id string, text string"), question=0.0, answer=0.0).count() == len(docs) - len([d for d in docs if d[0] in {x for x, _ in want}])
