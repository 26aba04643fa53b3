"""Token counts against the tokenizers library, on given texts, odd characters and long runs."""

import random

import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provrank.llm import token_count
from provrank.llm.queries import op11_token_count

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    with open(FILE, "rb") as f:
        return token_count.Counter(f.read())


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(FILE)


def expected(lib, texts):
    return [len(e.ids) for e in lib.encode_batch(list(texts), add_special_tokens=False)]


def test_whole_table_equals_the_library(spark, small, lib):
    got = op11_token_count(spark, small).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id")
    texts = docs["text"].fillna("")
    assert got["n_tokens"].tolist() == expected(lib, texts)
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in texts]
    assert got["over_limit"].tolist() == [n > 2048 for n in got["n_tokens"]] and got["over_limit"].any()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcABCéΣİß'’12२½<|>endoftxstar ́ ᠎​ 　\x1c\x1d\x1f\x85\t\n漢字가👍🏽ſK")), max_size=40))
def test_odd_characters(own, lib, text):
    assert own.of([text]) == expected(lib, [text])


def test_special_strings_separators_and_long_runs(own, lib):
    random.seed(5)
    texts = ["<|endoftext|><|startoftext|> x<|endoftext|>y", "a\x1cb \x1f c", "", " ", "<|EndOfText|>", "it's we'll 'S"]
    for n in (63, 64, 65, 66, 200, 3000):
        for letters in ("ae", "a", "abcdefghijklmnopqrstuvwxyz", ["in", "the", "a", "aaaa", "ing"]):
            texts += ["".join(random.choice(letters) for _ in range(n)) for _ in range(6)]
    texts.append("aaab" * 9000)
    assert own.of(texts) == expected(lib, texts)
    assert own.of(texts) == expected(lib, texts)  # now from the cache


def test_all_sequences_of_a_batch_merge_together(own):
    words = ["the", "thing", "x" * 500, "", "the"]
    assert own.merger.counts(words).tolist() == [own.merger.counts([w])[0] for w in words]
    assert own.merger.counts([]).tolist() == []


def test_long_windows_agree_with_waiting_for_the_lowest_pair(own):
    random.seed(9)
    words = ["".join(random.choice("aeinst") for _ in range(random.randint(65, 400))) for _ in range(60)] + ["a" * n for n in range(65, 99)]
    ids, lengths = own.merger.symbols(words)
    assert own.merger._survivors(ids, lengths, True).tolist() == own.merger._survivors(ids, lengths, False).tolist()


def test_vocabularies_that_are_not_supported():
    with pytest.raises(NotImplementedError):
        token_count.RankMerger({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, [("ab", "c"), ("a", "b")], "")


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, lib):
    rows = [(None, None, 1, "x"), (1, "", 2, "y"), (1, "", 2, "y"), (2, "one two " * 1500, 3, "z"), (3, "á é", 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, N_Bytes string")
    got = token_count.count_tokens(df, FILE).orderBy("doc_id", "n_tokens").collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(None, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 12000, 3000, True), (3, 6, 2, False)]
    empty = token_count.count_tokens(df.limit(0), FILE)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert token_count.count_tokens(df, FILE, limit=1).where("over_limit").count() == 2
