import random

import numpy as np
from pyspark.sql import functions as F

from provrank.llm import lang_id, quality

WORDS = {"en": "the of and that with from over water stone river".split(), "de": "der und die mit nicht über wasser stein fluss größe".split(), "xx": "zzk qqk vvk".split()}


def text(r, lang, n=40):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_language_held_out_and_edges(spark):
    r = random.Random(1)
    rows = [(i, text(r, ("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df.where("doc_id % 3 != 1"))
    got = {x.doc_id: x for x in lang_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "zzk qqk vvk " * 20, 5), (5, "der " * 50_000, 5), (5, "der " * 50_000, 5)], "doc_id long, text string, Score int")
    out = lang_id.identify(odd, model).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == 6 and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].rejected and by[4].lang_pred in ("en", "de") and by[5].lang_pred == "de"
    assert lang_id.identify(odd.limit(0), model).count() == 0
    nothing = lang_id.fit(df.limit(0))
    assert {x.lang_pred for x in lang_id.identify(df.limit(3), nothing).collect()} == {"und"}


def test_folds(spark):
    import zlib

    df = spark.range(50).select("id")
    got = {x.id: x.f for x in df.select("id", lang_id.fold(df.id, 3).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_quality_learns_and_handles_edges(spark):
    r = random.Random(2)
    good = [(i, text(r, "en", r.randint(20, 90)).capitalize() + ".", 1) for i in range(400)]
    bad = [(1000 + i, " | ".join(text(r, "xx", 3).upper() + "!!" for _ in range(30)), 0) for i in range(100)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(None, 1), (3, None), (7, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x.s for x in docs.select("doc_id", quality.score(docs, model).alias("s")).collect()}
    assert all((got[i] >= 0.3) == (y == 1) for i, _, y in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000)], "doc_id long, text string")
    s = [x.s for x in odd.select(quality.score(odd, model).alias("s")).collect()]
    assert len(s) == 4 and all(0 <= v <= 1 for v in s) and s[0] == s[1] and s[2] == s[3]
    assert odd.limit(0).select(quality.score(odd, model)).count() == 0
    assert quality.fit(docs, labels.limit(0)).score(np.zeros((1, quality.N_STATS)))[0] == 0.5
    assert quality.fit(docs, labels.where("quality = 1")).score(np.zeros((1, quality.N_STATS)))[0] == 1.0
    kept = quality.keep_good(docs.withColumn("extra", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "extra"] and kept.count() == 400


def test_isotonic_never_falls():
    x = np.random.default_rng(0).normal(size=300)
    y = (x + np.random.default_rng(1).normal(size=300) > 0).astype(float)
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()


def test_ridge_weights_equal_plain_normal_equations(spark):
    """Standardisation and weights from partition sums against one matrix of all fitting rows."""
    r = random.Random(4)
    rows = [(i, text(r, ("en", "de", "xx")[i % 3], r.randint(1, 80)) + "!" * (i % 3), int(i % 3 != 2)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), features=32)
    x = np.stack([quality.statistics(t) for _, t, _ in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) < 1e-9, 1, x.std(0)), rtol=1e-6)
    order = {q.doc_id: q.h for q in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    fitting = np.array([abs(order[i]) % 4 != 0 for i, _, _ in rows])
    s = np.clip((x - model.mean) / model.scale, -6, 6)
    z = np.hstack([np.sqrt(2 / 32) * np.cos(s @ model.freq + model.phase), s, np.ones((len(s), 1))])
    y = np.array([float(q) for _, _, q in rows])
    zf, yf = z[fitting], y[fitting]
    plain = np.linalg.lstsq(np.vstack([zf, np.sqrt(1e-3 * len(zf) / 100) * np.eye(z.shape[1])]), np.append(yf, np.zeros(z.shape[1])), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ plain, atol=1e-6)


def test_features_approximate_the_gaussian_kernel():
    r = np.random.default_rng(6)
    n, width = 4096, 3.0
    model = quality.QualityModel(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), r.normal(size=(quality.N_STATS, n)) / width, r.uniform(0, 2 * np.pi, n), np.zeros(0), np.zeros(1), np.zeros(1))
    x = r.normal(size=(30, quality.N_STATS))
    z = model.lift(x)[:, :n]
    gaps = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gaps / (2 * width**2))).max() < 0.1


def test_held_out_documents_of_the_tables(spark):
    """Languages and quality of documents that the fits didn't see, by the queries themselves."""
    from provrank.llm.queries import queries

    sf = "/root/testdata/sf0.01"
    of = {name.split("_")[0]: q for name, q in queries().items()}
    lang = of["op5"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = [(x.lang_pred == x.lang) for x in lang.where("held_out and lang is not null and lang_pred != 'und'").collect()]
    assert len(right) > 100 and sum(right) / len(right) >= 0.98
    quality_of = of["op7"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    held = [(x.score, x.quality, x.predicted) for x in quality_of.where("held_out and quality is not null").collect()]
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([p == q for _, q, p in held])
    print(len(right), sum(right), len(held), auc, accuracy)
    assert auc >= 0.98 and accuracy >= 0.95
