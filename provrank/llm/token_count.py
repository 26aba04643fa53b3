"""Token counts under a byte-level BPE vocabulary with word ends, by rank-synchronous merging of ragged arrays.

The pre-tokens of an Arrow batch lie one after another in one array of symbol ids. In each round every
sequence applies its lowest-rank pair, all of them at once; sequences with no pair left leave the array,
and what counts is how many symbols survive. A sequence of more than ``2 * span`` symbols (span: the most
symbols that any token holds) doesn't wait for its one lowest pair: a pair is applied as soon as none
within span symbols of it has a lower rank, since no token reaches further, so no merge elsewhere can
come first. Equal pairs that overlap go from the left.

This is exact for vocabularies in which each merge stands after the merges that make its parts, which is
checked when a file is read. Normalisation, pre-tokenisation and special strings are the library's.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns, small_batches

#: Entries of each of the two generations of the cache of stretches between white space.
CACHE = 200_000
#: Longer stretches are not kept in the cache.
KEPT_CHARS = 64
#: Newly counted stretches of an Arrow batch that are checked against the library.
CHECKED = 32
#: A vocabulary file may hold as many bytes; it goes to every executor.
MAX_FILE = 64 << 20
_NONE = np.int32(np.iinfo(np.int32).max)
#: Python counts these as white space, the tokenizer's expressions don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")
#: What one known way of cutting does to lower-case printable ASCII without white space.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


class RankMerger:
    """Merge ranks as sorted arrays: for a pair of symbol ids its rank and the id of their union."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        made: dict[str, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            low, high = made.get(joined := _joined(a, b, suffix), (rank, rank))
            made[joined] = (min(low, rank), max(high, rank))
        if any(made.get(part, (0, -1))[1] >= rank for rank, pair in enumerate(merges) for part in pair):
            raise NotImplementedError("a merge stands before one that makes its part")
        self.vocab, self.suffix = vocab, suffix
        # a pair that is listed twice counts with its last rank, as in the library's table
        by_pair = {(vocab[a] << 32) | vocab[b]: (rank, vocab[_joined(a, b, suffix)]) for rank, (a, b) in enumerate(merges)}
        keys = np.array(sorted(by_pair), dtype=np.int64)
        self.keys = keys
        self.ranks = np.array([by_pair[k][0] for k in keys.tolist()], dtype=np.int32)
        self.unions = np.array([by_pair[k][1] for k in keys.tolist()], dtype=np.int64)
        self.span = max(len(t.removesuffix(suffix)) for t in vocab) if vocab else 1

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol ids of all words in one array, and each word's length."""
        get, suffix, ids, lengths = self.vocab.get, self.suffix, [], []
        for w in words:
            own = [i for c in w[:-1] if (i := get(c)) is not None] + ([i] if w and (i := get(w[-1] + suffix)) is not None else [])
            ids += own
            lengths.append(len(own))
        return np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64)

    def _ranks(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the rank and the union of the pair that begins there; none at the end of a sequence."""
        rank, union = np.full(len(ids), _NONE), np.zeros(len(ids), dtype=np.int64)
        if len(ids) > 1 and len(self.keys):
            pair = (ids[:-1] << 32) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = self.keys[at] == pair
            rank[:-1][hit], union[:-1][hit] = self.ranks[at[hit]], self.unions[at[hit]]
            rank[ends] = _NONE
        return rank, union

    def _lowest_near(self, rank: np.ndarray) -> np.ndarray:
        """The lowest rank within span positions of each, by doubling."""
        width = 1
        padded = np.pad(rank, self.span, constant_values=_NONE)
        while 2 * width <= 2 * self.span + 1:
            padded = np.minimum(padded[: len(padded) - width], padded[width:])
            width *= 2
        n = len(rank)
        right = 2 * self.span + 1 - width
        return np.minimum(padded[:n], padded[right : right + n])

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word."""
        ids, lengths = self.symbols(words)
        out = np.zeros(len(words), dtype=np.int64)
        long = lengths > 2 * self.span
        each = np.repeat(np.arange(len(words)), lengths)
        for group, whole in ((~long, True), (long, False)):
            index = np.flatnonzero(group & (lengths > 0))
            if len(index):
                out[index] = self._survivors(ids[group[each]], lengths[index], whole)
        return out

    def _survivors(self, ids: np.ndarray, lengths: np.ndarray, whole: bool) -> np.ndarray:
        """lengths after all merges; whole: wait for each sequence's lowest rank, else for the lowest within reach."""
        out, live = lengths.copy(), np.arange(len(lengths))
        while len(live):
            starts = np.cumsum(lengths) - lengths
            rank, union = self._ranks(ids, starts + lengths - 1)
            low = np.minimum.reduceat(rank, starts)
            going = low != _NONE
            if not going.all():
                keep = np.repeat(going, lengths)
                out[live[~going]] = lengths[~going]
                ids, rank, union, live, lengths, low = ids[keep], rank[keep], union[keep], live[going], lengths[going], low[going]
                if not len(live):
                    break
                starts = np.cumsum(lengths) - lengths
            best = np.repeat(low, lengths) if whole else self._lowest_near(rank)
            ready = (rank == best) & (rank != _NONE)
            # overlapping equal pairs: from the first of their run every other one, as far as all from the first are ready
            position = np.arange(len(ids))
            first = np.r_[True, rank[1:] != rank[:-1]]
            head = np.maximum.accumulate(np.where(first, position, 0))
            waiting = np.cumsum(~ready)
            before = np.where(head > 0, waiting[head - 1], 0)
            merge = ready & (waiting == before) & ((position - head) % 2 == 0)
            ids = np.where(merge, union, ids)
            gone = np.r_[False, merge[:-1]]
            lengths = lengths - np.add.reduceat(gone, starts)
            ids = ids[~gone]
        return out


def _joined(a: str, b: str, suffix: str) -> str:
    return a.removesuffix(suffix) + b if suffix else a + b


class Kept:
    """Counts of strings met before, in two generations of bounded size; what is used again stays."""

    def __init__(self) -> None:
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def look_up(self, wanted: dict[str, int | None]) -> list[str]:
        """Fill in the counts that are known; the strings without one."""
        new, old = self.new.get, self.old.get
        fresh = []
        for s in wanted:
            n = new(s)
            if n is None and (n := old(s)) is None:
                fresh.append(s)
            else:
                wanted[s] = n
        return fresh

    def add(self, counts: dict[str, int]) -> None:
        if len(self.new) + len(counts) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update(counts if max(map(len, counts), default=0) <= KEPT_CHARS else {s: n for s, n in counts.items() if len(s) <= KEPT_CHARS})


class Counter:
    """Token counts of texts under one vocabulary file of the tokenizers library."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("fuse_unk") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("unk_token"):
            raise NotImplementedError("only BPE without dropout, prefixes, unknown token, byte fallback and ignored merges")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise NotImplementedError("only added tokens that are found as they stand")
        if not _cuts_at_spaces(spec):
            raise NotImplementedError("only normalisers and pre-tokenisers known to work between white space alone")
        self.lib = Tokenizer.from_str(content.decode())
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = RankMerger(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.ascii = steps[0]["pattern"]["Regex"] == _SPLIT and normal[-1:] == ["Lowercase"]
        self.kept = Kept()
        self.words = Kept()

    def stretches(self, text: str) -> tuple[list[str], int]:
        """The stretches between white space, and how many added tokens the text holds."""
        parts, special = [text], 0
        if self.special:
            parts = self.special.split(text)
            special = len(parts) - 1
        cut = _SPACES.split if _SEPARATORS.search(text) else str.split
        return [s for p in parts for s in cut(p) if s], special

    def of(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut = [self.stretches(t) for t in texts]
        known = dict.fromkeys({s for own, _ in cut for s in own})
        fresh = self.kept.look_up(known)
        if fresh:
            known.update(zip(fresh, self._count(fresh), strict=True))
            self._check(fresh, known)
        self.kept.add(known)
        get = known.__getitem__
        return [special + sum(map(get, own)) for own, special in cut]

    def _cut(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch, their bytes as the vocabulary writes them."""
        if self.ascii and stretch.isascii() and stretch.isprintable():
            return [stretch.lower()] if stretch.isalpha() else _ASCII_WORDS(stretch.lower())
        normal = self.lib.normalizer
        return [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(normal.normalize_str(stretch) if normal else stretch)]

    def _count(self, stretches: list[str]) -> list[int]:
        words = list(map(self._cut, stretches))
        known = dict.fromkeys({w for own in words for w in own})
        fresh = self.words.look_up(known)
        if fresh:
            known.update(zip(fresh, self.merger.counts(fresh).tolist(), strict=True))
        self.words.add(known)
        return [known[own[0]] if len(own) == 1 else sum(known[w] for w in own) for own in words]

    def _check(self, fresh: list[str], known: dict[str, int]) -> None:
        """Raise unless the library agrees on some new stretches, chosen by hash, and the longest of them."""
        some = sorted(fresh, key=lambda s: zlib.crc32(s.encode()))[:CHECKED]
        some.append(max(fresh, key=len))
        for s, got in zip(some, self.lib.encode_batch(some, add_special_tokens=False), strict=True):
            if known[s] != len(got.ids):
                raise AssertionError(f"another count than the library for {s[:80]!r}")


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether stretches between white space can be normalised and cut one by one."""
    plain = {"NFC", "NFD", "NFKD", "Lowercase"}  # composition and case of a letter don't reach over white space
    normal = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    for n in normal["normalizers"] if normal["type"] == "Sequence" else [normal]:
        if n["type"] not in plain and not (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "):
            return False
    before = spec["pre_tokenizer"] or {"type": "?"}
    steps = before["pretokenizers"] if before["type"] == "Sequence" else [before]
    split = steps[0]
    # matches are kept and hold no white space, whatever else is dropped
    spaceless = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+") and "\\s" not in split["pattern"]["Regex"].removesuffix("[^\\s\\p{L}\\p{N}]+")
    rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    return spaceless and rest and len(steps) == 2


@lru_cache(maxsize=2)
def counter(content: bytes) -> Counter:
    return Counter(content)


def count_tokens(df: DataFrame, tokenizer_file: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """df with n_bytes (of the text in UTF-8), n_tokens and over_limit (more than limit tokens); no begin or end token counts.

    The driver reads the file and sends its content with the tasks. A null or empty text has no bytes and
    no tokens. Special strings in a text count as one token each, as the library does by default. Texts of
    any length are counted whole. Columns named n_bytes, n_tokens or over_limit give way. Each row is
    judged by itself: repeated rows and repeated ids stay.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_file, "rb") as f:
        content = f.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"a vocabulary file may have {MAX_FILE} bytes")
    sent = spark.sparkContext.broadcast(content)

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series(counter(sent.value).of(["" if t is None else t for t in text]), dtype="int64")

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = df.withColumn("__tokens", tokens(text))
    return add_columns(counted, {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": F.col("__tokens"), "over_limit": F.col("__tokens") > limit}).drop("__tokens")
