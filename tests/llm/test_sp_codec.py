import hashlib

import numpy as np
import pytest

from provrank.llm.queries import sp_model
from provrank.llm.sp_codec import BpeCodec, encode_decode

TEXTS = ["", "a", " a", "  a  b ", "\n", "\n\n x", "a\tb ▁ x▁▁y", "<s> </s> <0x0A>", "ñandú ☃ 日本語 ​", "x" * 3000, "a b\n c  ", " ", "   ", "▁", "\r\n", " " * 40 + "x", "　", "🙂🙂", "a\x00b", "<unk>", "The quick, brown fox.\nJumps ² over 3½ dogs_and __init__ %%% x"]


@pytest.fixture(scope="module")
def own():
    return BpeCodec(sp_model())


@pytest.mark.parametrize("text", TEXTS)
def test_equals_library(own, text):
    ids = own.lib.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == ids
    assert own.decode(own.encode(text)) == own.lib.decode(ids)


def test_decode_of_any_ids(own):
    rng = np.random.default_rng(0)
    for _ in range(500):
        ids = rng.integers(0, 600, 7).tolist()
        assert own.decode(np.array(ids, dtype="<u4").tobytes()) == own.lib.decode(ids), ids


def test_random_texts(own):
    import random

    r = random.Random(1)
    for _ in range(400):
        t = "".join(r.choice("abe thé.,\n ▁1²_☃%ing ") for _ in range(r.randint(0, 60)))
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == own.lib.encode(t, add_bos=True, add_eos=True), t


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(98, None, "x"), (98, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = encode_decode(df, sp_model()).collect()
    assert len(out) == len(rows)
    lib = BpeCodec(sp_model()).lib
    for x in out:
        ids = lib.encode(x.text or "", add_bos=True, add_eos=True)
        assert hashlib.sha256(bytes(x.ids)).digest() == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).digest()
    assert encode_decode(df.limit(0), sp_model()).count() == 0
