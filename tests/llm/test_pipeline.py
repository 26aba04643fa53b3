"""The pipeline against a plain version of each stage, over the smallest tables."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from provrank.llm import decontam, quality  # noqa: E402
from provrank.llm.omh_dedup import words_of  # noqa: E402
from provrank.llm.queries import sp_model  # noqa: E402
from provrank.llm.sp_codec import BpeCodec  # noqa: E402

from .test_line_dedup import plain  # noqa: E402
from .test_omh_dedup import brute  # noqa: E402


def test_run_equals_plain_stages(spark, small):
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    frame = spark.read.parquet(f"{small}/documents.parquet")
    kept_labels = spark.createDataFrame([(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5], "doc_id long, quality int")
    model = quality.fit(frame, kept_labels)
    rows = {i: r for i, r in docs.items() if model.score(quality.statistics(r.text)[None])[0] >= 0.3}
    _, bad = plain([(r.source, r.text) for r in rows.values()])
    text = {i: "\n".join(x for x in r.text.split("\n") if x not in bad[r.source]) for i, r in rows.items()}
    classes = brute(list(text.items()))
    text = {i: t for i, t in text.items() if classes[i] == i}
    items = [(r.item_id, " " + " ".join(words_of(r.text)) + " ") for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    text = {i: t for i, t in text.items() if not any(x in " " + " ".join(words_of(t)) + " " for _, x in items)}
    lib = BpeCodec(sp_model()).lib
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == lib.encode(text[i], add_bos=True, add_eos=True)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0
    assert decontam.SHARD > 0


def test_stages_with_nulls_repeats_and_long_texts(spark, small):
    """Line dedup, near-dedup, decontamination and tokens over odd rows, nulls in every column."""
    schema = spark.read.parquet(f"{small}/documents.parquet").schema.add("class_id", "string")
    texts = {1: None, 2: "", 3: "one two three four five six seven", 4: "one two three four five six seven", 5: "word " * 30_000, 6: "!!! \n\n"}
    of = lambda i, t: tuple({"doc_id": i, "text": t}.get(f.name) for f in schema)
    docs = spark.createDataFrame([of(i, t) for i, t in [*texts.items(), (5, texts[5]), (None, "no id at all")]], schema)
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, small)
    near = stages["near_dedup"](spark, docs, small)
    clean = stages["decontamination"](spark, docs, small)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.select("doc_id").collect())
    assert lines.columns == near.columns == clean.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.where("doc_id is not null").collect()} == texts
    assert ids(lines) == ids(clean) == [0, 1, 2, 3, 4, 5, 5, 6] and ids(near) == [0, 1, 2, 3, 5, 6]
    n = {r.doc_id: r.n_tokens for r in stages["sentencepiece"](spark, docs, small).collect()}
    assert n[1] == n[2] == 2 and n[5] >= 30_000
