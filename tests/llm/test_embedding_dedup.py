import numpy as np

from provrank.llm.embedding_dedup import learn_rotations, link, plan, substrings


def brute(x, t=0.9):
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = v @ v.T >= t
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *[root[j] for j in np.flatnonzero(near[i])]]) for i in range(len(x))]
        if new == root:
            break
        root = new
    return near.sum(axis=1), root


def vectors(seed=0, n=400, d=32):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for k in range(40):  # near copies at many angles
        x[200 + k] = x[k] / np.linalg.norm(x[k]) + r.normal(size=d) * 0.3 * k / 40 / np.sqrt(d)
    x[300:310] = x[0]
    return x.astype(np.float32).astype(float)


def test_links_and_components(spark):
    x = vectors()
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {r.id: r for r in link(df).collect()}
    n, root = brute(x)
    found = sum(min(out[i].n_links, n[i]) for i in out)
    assert found >= 0.95 * n.sum() and all(out[i].n_links <= n[i] for i in out)
    assert out[300].n_links == n[300] and out[300].component_id == 0 and not out[300].kept
    assert sum(out[i].component_id == root[i] for i in out) >= 0.97 * len(x)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    out = link(df).collect()
    assert len(out) == len(rows)
    by = {r.id: r for r in out}
    assert by[2].n_links == 2 and by[2].component_id == 1 and not by[2].kept
    assert [r.n_links for r in out if r.id == 1] == [2, 2]
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9))
    assert link(df.limit(0)).count() == 0 and link(df.where("vec_id = 3")).count() == 1


def test_big_bucket_is_cut_into_cells(spark, monkeypatch):
    import provrank.llm.embedding_dedup as m

    monkeypatch.setattr(m, "CHUNK", 16)
    r = np.random.default_rng(2)
    x = (np.ones((90, 8)) + r.normal(size=(90, 8)) * 0.05).astype(np.float32)
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in link(df).collect()} == {(89, 0)}


def test_plan_and_codes():
    assert plan(10_000, 0.9, 0.97)[0] < plan(10_000_000, 0.9, 0.97)[0]
    x = np.random.default_rng(1).normal(size=(200, 16))
    rot = learn_rotations(x, 2)
    assert np.allclose(rot[:, :16].T @ rot[:, :16], np.eye(16), atol=1e-8)
    assert substrings(x, rot, 4, 6).shape == (200, 6)


def test_lengths_apart_and_very_large_numbers(spark):
    x = [v.tolist() for v in vectors(3, 320)] + [[1e200 * z for z in v] for v in vectors(3, 320)[:20].tolist()]
    short = [[1.0, 0.01 * k] for k in range(9)] + [[-1.0, 1.0]]
    rows = [*enumerate(x), *[(1000 + k, v) for k, v in enumerate(short)], (None, [1.0, 0.0]), (2000, [5.0])]
    out = {r.id: r for r in link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(out[320 + k].component_id == out[k].component_id and out[320 + k].n_links >= 1 for k in range(20))
    assert [(out[1000 + k].n_links, out[1000 + k].component_id) for k in range(10)] == [(9, 1000)] * 9 + [(0, 1009)]
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (9, 1000, False) and out[2000].kept


def test_recall_of_planted_pairs_at_the_threshold(spark):
    """Pairs at cosine 0.9 to 0.92 among 6,000 vectors, against all pairs."""
    r = np.random.default_rng(11)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(600):
        side = r.normal(size=64)
        side -= (side @ x[k]) * x[k]
        c = 0.9 + 0.02 * k / 600
        x[3000 + k] = c * x[k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    n, _ = brute_links(x)
    out = {v.id: v.n_links for v in link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert n.sum() >= 1100 and sum(min(out[i], n[i]) for i in out) >= 0.93 * n.sum() and all(out[i] <= n[i] for i in out)


def brute_links(x, t=0.9):
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    return near.sum(axis=1), near
