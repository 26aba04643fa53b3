"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies with a score-ordered agenda.

The agenda holds adjacent symbol pairs whose union is a piece, best score first, leftmost first among
equals; a popped pair that is still whole is merged and its new neighbours enter. A text is cut
where two adjacent characters stand side by side in no piece: no merge can cross such a place, so the
parts are encoded one by one and kept in a cache of bounded size.
Each Arrow batch checks words it newly encoded, and one whole text, against the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns, small_batches

SPACE = "▁"
_LETTER = rf"[^\W\d_{SPACE}]"
#: Newly encoded words of an Arrow batch that are checked against the library.
CHECKED = 64
#: Entries of each generation of a cache of encoded parts.
CACHE = 150_000


class TwoGenerations(dict):
    """A cache of bounded size: when it is full it becomes the old generation, from which entries that are used again come back."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size
        self.old: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class BpeCodec:
    """The pieces of a model file, read through the library; only identity normalisation with a dummy prefix and byte fallback is supported."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        odd = [p.piece for p in proto.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback or odd:
            raise NotImplementedError("only BPE models with identity normalisation, dummy prefix and byte fallback")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_ids = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.adjacent = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        letter = lambda c: re.match(_LETTER, c) is not None
        apart = all((letter(a) == letter(b) or a == SPACE) and (b != SPACE or a == SPACE) for a, b in self.adjacent)
        self.cut = re.compile(f"{SPACE}*{_LETTER}+|{SPACE}*(?:[^\\w{SPACE}]|[\\d_])+|{SPACE}+").findall if apart else None
        hidden = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.bytes_of = [b"" if i in hidden else byte_of[i] if i in byte_of else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)]
        self.is_byte = set(self.byte_ids)
        self.units = TwoGenerations(2 * CACHE)
        self.words = TwoGenerations(CACHE)
        self.fresh: list[tuple[str, bytes]] = []

    def agenda(self, unit: str) -> list[int]:
        """The ids of one part by the score-ordered agenda."""
        part = list(unit)
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score, push, pop = self.scores.get, heapq.heappush, heapq.heappop
        heap = [(-s, i, i + 1, both) for i in range(n - 1) if (s := score(both := part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, both = pop(heap)
            if after[left] != right or part[left] + part[right] != both:
                continue
            part[left], part[right] = both, ""
            far, near = after[right], before[left]
            after[left], after[right] = far, -2
            if far >= 0:
                before[far] = left
                if (s := score(joined := both + part[far])) is not None:
                    push(heap, (-s, left, far, joined))
            if near >= 0 and (s := score(joined := part[near] + both)) is not None:
                push(heap, (-s, near, left, joined))
        out: list[int] = []
        for p in part:
            if p:
                i = self.ids.get(p)
                out += [self.byte_ids[b] for b in p.encode()] if i is None else [i]
        return out

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit) or self.units.recall(unit)
        if found is None:
            found = np.array(self.agenda(unit), dtype="<u4").tobytes()
            if len(unit) <= 48:
                self.units.keep(unit, found)
        return found

    def _parts(self, text: str) -> bytes:
        """A text with its spaces marked, cut where no piece joins two characters."""
        if self.cut:
            return b"".join(map(self._unit, self.cut(text)))
        out, start = [], 0
        for k, pair in enumerate(zip(text, text[1:], strict=False), 1):
            if pair not in self.adjacent:
                out.append(self._unit(text[start:k]))
                start = k
        return b"".join([*out, self._unit(text[start:])])

    def _word(self, word: str) -> bytes:
        """A word with the space before it; no piece holds a space mark after another character, so it stands alone."""
        found = self.words.recall(word)
        if found is None:
            found = self._parts(SPACE + word)
            if len(self.fresh) < CHECKED:
                self.fresh.append((word, found))
            if len(word) <= 48:
                self.words.keep(word, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """All ids, with begin and end, as little-endian 32-bit integers; null counts as empty."""
        ends = np.array([self.bos, self.eos], dtype="<u4").tobytes()
        if not text:
            return ends
        if SPACE in text or "  " in text or text[0] == " ":
            return ends[:4] + self._parts(SPACE + text.replace(" ", SPACE)) + ends[4:]
        get, words = self.words.get, text.split(" ")
        return b"".join([ends[:4], *[get(w) or self._word(w) for w in words], ends[4:]])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: byte pieces joined into UTF-8, the first piece's space dropped."""
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            out = raw.decode()
        except UnicodeDecodeError:  # U+FFFD for each byte that belongs to no character
            out = "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else "�" for c in raw.decode("utf-8", "surrogateescape"))
        first = next((i for i in ids if self.bytes_of[i]), None)
        return out[1:] if first is not None and first not in self.is_byte and first != self.lib.unk_id() and out.startswith(" ") else out

    def check(self, sample: str | None) -> None:
        """Raise unless the library agrees on the words encoded since the last check and on one whole text."""
        fresh, self.fresh = [x for x in self.fresh if x[0]], []
        if fresh:
            lib = self.lib.encode([w for w, _ in fresh], num_threads=1)
            for (word, own), ids in zip(fresh, lib, strict=True):
                if own != np.array(ids, dtype="<u4").tobytes():
                    raise AssertionError(f"other ids than the library for {word!r}")
        if sample is not None:
            packed = self.encode(sample)
            ids = self.lib.encode(sample, add_bos=True, add_eos=True)
            if np.frombuffer(packed, dtype="<u4").tolist() != ids or self.decode(packed) != self.lib.decode(ids):
                raise AssertionError(f"other ids or text than the library for {sample[:80]!r}")


@lru_cache(maxsize=2)
def codec(model_file: str) -> BpeCodec:
    return BpeCodec(model_file)


def round_trip(texts: Iterable[str | None], model_file: str) -> tuple[list[bytes], list[str]]:
    own = codec(model_file)
    packed, back, shortest = [], [], None
    for t in texts:
        packed.append(own.encode(t))
        back.append(own.decode(packed[-1]))
        if t and (shortest is None or len(t) < len(shortest)):
            shortest = t
    own.check(shortest)
    return packed, back


def encode_decode(df: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """df with ids (all ids of the whole text, packed as little-endian 32-bit integers) and decoded (the text of those ids).

    A null text counts as empty: begin and end id, empty text. Columns named ids or decoded give way.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("ids binary, decoded string")
    def both(text: pd.Series) -> pd.DataFrame:
        packed, back = round_trip(text, model_file)
        return pd.DataFrame({"ids": packed, "decoded": back})

    out = df.withColumn("__sp", both(F.col(f"`{text_col}`")))
    return add_columns(out, {"ids": F.col("__sp.ids"), "decoded": F.col("__sp.decoded")}).drop("__sp")
