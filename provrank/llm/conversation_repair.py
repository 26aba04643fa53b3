"""Conversation structure repair: the cheapest edits that make roles a dialogue, by one dynamic program over a trie.

A conversation becomes a signature, one character a row for its role and fault. Equal signatures are
counted once. They go sorted into a prefix trie; a node holds the layer of the dynamic program for its
prefix, computed when the node is made, so conversations that begin alike share layers. A terminal node
gives the answer for all conversations of its signature. As signatures arrive in order, a branch
that no later one can enter is dropped: the trie in memory is one path with its layers.

Conversations of any size: rows are range-partitioned by conversation and turn and sorted, so a large
conversation lies in many tasks, and come out as pieces of bounded size. Only characters of the
signature meet again (one for each row, as in the audit that is asked for). What is repaired is joined to
the pieces, and the digest of a conversation in several pieces runs over them in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns, materialize, partitions, release

#: A piece of a conversation has at most as many rows and, beyond its first row, as many characters.
PIECE_ROWS = 256
PIECE_CHARS = 1 << 18
#: Rows of one turn and role go by so many first characters of their text, then by its digest.
TIE_CHARS = 64
ROLES = "sua"
FAULTS = ("", "truncated", "blank", "duplicate")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = r"\x20\x09-\x0D"
#: States of the pattern (s?(ua)+)?: nothing yet, after the system row, after a user row, after an assistant row.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {(_EMPTY, "s"): _SYSTEM, (_EMPTY, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The role that can follow a state by an inserted or renamed row.
_TURN = {_EMPTY: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}


# --- the dynamic program -------------------------------------------------------------------------


def symbol(role: int, fault: int) -> str:
    """The character of a row: role 0 to 3 (system, user, assistant, other) and fault (index in FAULTS)."""
    return "0123456789abcdef"[4 * role + fault]


@dataclass(slots=True)
class Layer:
    """For each state the cheapest way to it that ends with a row's edit: cost, rank of its audit, and the step behind it.

    Such audits of equally many rows are never a prefix of one another, so comparing two continuations
    takes the rank of what they continue and the letters they add, not the whole audits.
    """

    cost: list[int | None]
    rank: list[int]
    behind: list[tuple[int, str]]  # (state in the layer before, script since)


_START = Layer([0, None, None, None], [0, 0, 0, 0], [(0, "")] * 4)


def _openings(layer: Layer) -> Iterator[tuple[int, int, int, int, str]]:
    """(cost, rank, state before, state, inserted): every state, also by inserts, which could come before a row."""
    for state, cost in enumerate(layer.cost):
        if cost is not None:
            now, script = state, ""
            for _ in range(3):  # a third insert in a row returns to a state already passed, at a higher cost
                yield cost + INSERT * len(script), layer.rank[state], state, now, script
                role = _TURN[now]
                now, script = _NEXT[now, role], script + role.upper()


def following(layer: Layer, sign: str) -> Layer:
    """The layer after one more row."""
    kind, fault = divmod(int(sign, 16), 4)
    best: list[tuple[int, int, str, int, str] | None] = [None] * 4

    def offer(state: int, cost: int, rank: int, script: str, before: int) -> None:
        found = (cost, rank, audit_of(script), before, script)
        if best[state] is None or found[:3] < best[state][:3]:
            best[state] = found

    for cost, rank, before, now, script in _openings(layer):
        offer(now, cost + DELETE, rank, script + "D", before)
        if fault < 2:
            extra = cost + TRUNCATED * fault
            if kind < 3 and (now, ROLES[kind]) in _NEXT:
                offer(_NEXT[now, ROLES[kind]], extra, rank, script + "K", before)
            role = _TURN[now]
            offer(_NEXT[now, role], extra + REROLE, rank, script + role, before)
    order = sorted((b[1:3], s) for s, b in enumerate(best) if b)
    rank = [0] * 4
    for k, (_, s) in enumerate(order):
        rank[s] = k
    return Layer([b[0] if b else None for b in best], rank, [(b[3], b[4]) if b else (0, "") for b in best])


def audit_of(script: str) -> str:
    """Edit initials of a script: K kept, D deleted, u and a renamed, U and A inserted."""
    return script.translate(_INITIALS)


_INITIALS = str.maketrans({"u": "R", "a": "R", "U": "I", "A": "I"})


def finish(layers: list[Layer]) -> tuple[int, str]:
    """Cost and script of the cheapest whole repair, given the layers of a signature's prefixes."""
    ends = [(cost, rank, audit_of(script), before, script) for cost, rank, before, now, script in _openings(layers[-1]) if now in (_EMPTY, _ASSISTANT)]
    cost, _, _, state, script = min(ends)
    parts = [script]
    for layer in reversed(layers[1:]):
        state, script = layer.behind[state]
        parts.append(script)
    return cost, "".join(reversed(parts))


# --- the trie ------------------------------------------------------------------------------------


@dataclass(slots=True)
class Node:
    """A prefix: its layer, what is counted along it, and its children."""

    sign: str
    layer: Layer
    counts: tuple[int, int, int, int]  # illegal neighbours, blank, duplicate, truncated rows
    children: dict[str, Node] = field(default_factory=dict)


class SignatureTrie:
    """A prefix trie for signatures in ascending order; it keeps the path of the last one."""

    def __init__(self) -> None:
        self.path = [Node("", _START, (0, 0, 0, 0))]
        self.last = ""
        self.made = 0

    def insert(self, signature: str) -> list[Node]:
        """The path of a signature, layers made for what it doesn't share with the one before."""
        if signature < self.last:
            raise ValueError("signatures must come in ascending order")
        shared = 0
        for a, b in zip(signature, self.last, strict=False):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for sign in signature[shared:]:
            top = self.path[-1]
            top.children = {sign: (node := self._child(top, sign))}  # no later signature enters an earlier sibling
            self.path.append(node)
        self.last = signature
        return self.path

    def _child(self, top: Node, sign: str) -> Node:
        self.made += 1
        kind, fault = divmod(int(sign, 16), 4)
        illegal, blank, duplicate, truncated = top.counts
        if top.sign:
            illegal += f"{int(top.sign, 16) // 4}{kind}" not in ("01", "12", "21")
        return Node(sign, following(top.layer, sign), (illegal, blank + (fault == 2), duplicate + (fault == 3), truncated + (fault == 1)))

    def answer(self, signature: str) -> tuple:
        """(signature, blank, duplicate, truncated, illegal, cost, script) of a signature's terminal node."""
        path = self.insert(signature)
        illegal, blank, duplicate, truncated = path[-1].counts
        return signature, blank, duplicate, truncated, illegal, *finish([n.layer for n in path])


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = SignatureTrie()
    for pdf in batches:
        yield pd.DataFrame([trie.answer(s) for s in pdf["signature"]], columns=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "script"])


# --- rows, pieces, conversations -----------------------------------------------------------------


def faulty_rows(rows: DataFrame) -> DataFrame:
    """rows (id, turn, role, text, copy) with digest and sign; a row's first fault counts.

    A later row of the same role and text is found by the first place of each such pair: counted by a
    grouped minimum, so a text that a large conversation repeats is summed before it is shuffled.
    """
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"), "copy")
    rows = rows.withColumn("digest", F.sha2(F.col("text"), 256))
    first = rows.groupBy("id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("id").alias("id_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "first")
    met = rows.join(first, F.col("id").eqNullSafe(F.col("id_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")), "left")
    end = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    fault = F.when(end == "", 2).when(place > F.col("first"), 3).when(~end.isin(".", "!", "?"), 1).otherwise(0)
    start = F.substring("role", 1, 1)
    kind = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    return met.select("id", "turn", "role", "text", "copy", "digest", F.lower(F.hex((kind * 4 + fault).cast("long"))).alias("sign"))


def _into_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as pieces: of one conversation, in order, of bounded size."""
    part, block, held, chars, like = TaskContext.get().partitionId(), 0, [], 0, None

    def piece() -> tuple:
        return held[0][0], part, block, "".join(r[4] for r in held), [r[2] for r in held], [r[3] for r in held]

    for batch in batches:
        like, out = batch.column("id").type, []
        for row in zip(*[batch.column(c).to_pylist() for c in ("id", "turn", "role", "text", "sign")], strict=True):
            if held and row[:4] == held[-1][:4] and int(row[4], 16) % 4 != 2:  # a repeated row; all of its kind lie here side by side
                row = (*row[:4], symbol(int(row[4], 16) // 4, 3))
            if held and (row[0] != held[0][0] or len(held) >= PIECE_ROWS or chars + len(row[3]) > PIECE_CHARS):
                out.append(piece())
                block, held, chars = block + 1, [], 0
            held.append(row)
            chars += len(row[3])
        if out:
            yield _pieces_batch(out, like)
    if held:
        yield _pieces_batch([piece()], like)


def _pieces_batch(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
    id_, part, block, signature, roles, texts = map(list, zip(*rows, strict=True))
    words = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(id_, like), pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(signature, pa.string()), pa.array(roles, words), pa.array(texts, words)], names=["id", "part", "block", "signature", "roles", "texts"])


def _slices(signatures: list[str], script: str) -> list[str]:
    """A script cut where pieces end; inserts go with the row behind them, the last ones with the last piece."""
    out, at = [], 0
    for k, own in enumerate(signatures):
        begin, rows = at, 0
        while at < len(script) and (rows < len(own) or k == len(signatures) - 1):
            rows += script[at] not in "UA"
            at += 1
        out.append(script[begin:at])
    return out


def _repaired(roles: list[str], texts: list[str], script: str) -> str | None:
    """The repaired rows of a piece as lines of role:text; None where no row is left."""
    lines, k, names = [], 0, {"u": "user", "a": "assistant"}
    for step in script:
        if step in "UA":
            lines.append(f"{names[step.lower()]}:")
            continue
        if step != "D":
            lines.append(f"{roles[k] if step == 'K' else names[step]}:{texts[k]}")
        k += 1
    return "\n".join(lines) if lines else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each conversation, over its sorted pieces one at a time."""
    last, hasher, lines, like = None, None, False, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], like), pa.array([r[1] for r in rows], pa.string())], names=["id", "sha256"])

    for batch in batches:
        like, out = batch.column("id").type, []
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("repaired").to_pylist(), strict=True):
            if hasher is None or id_ != last:
                if hasher:
                    out.append((last, hasher.hexdigest()))
                last, hasher, lines = id_, hashlib.sha256(), False
            if text is not None:
                hasher.update((("\n" if lines else "") + text).encode())
                lines = True
        if out:
            yield batch_of(out)
    if hasher:
        yield batch_of([(last, hasher.hexdigest())])


def repair(rows: DataFrame, id_col: str = "conv_id", copy_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired pieces, from rows of (id_col, turn, role, text[, copy_col]).

    Conversations: id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.
    Pieces: id, part, block (their order), repaired (lines of role:text, null where none is left).
    Rows go by turn, nulls first; ties by role, the text's first 64 characters, its digest, and copy_col. A null role or text counts as one space, a null id is an id. Texts and conversations may have
    any length; no rows give no conversations. Other columns of rows are not read.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    copy = F.col(f"`{copy_col}`").cast("int") if copy_col else F.lit(0)
    rows = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copy.alias("copy"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    order = ["id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, TIE_CHARS), "digest", "copy"]
    dealt = faulty_rows(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "turn", "role", "text", "sign")
    pieces = materialize(dealt.mapInArrow(_into_pieces, f"id {kind}, part int, block long, signature string, roles array<string>, texts array<string>"), "pieces")

    whole = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "block", "signature"))).alias("own"))
    whole = materialize(whole.select("id", "own", F.array_join(F.col("own.signature"), "").alias("signature")), "signatures")
    answers = (
        whole.select("signature").distinct().repartitionByRange(n, "signature").sortWithinPartitions("signature")
        .mapInPandas(_answers, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, script string")
    )
    turns = rows.select("id", "turn").distinct().groupBy("id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    turns = turns.withColumnRenamed("id", "id_")
    solved = whole.join(answers, "signature").join(turns, F.col("id").eqNullSafe(F.col("id_"))).drop("id_", "signature")
    solved = materialize(solved, "solved")

    sliced = F.pandas_udf(lambda own, script: pd.Series([_slices(list(o), t) for o, t in zip(own, script, strict=True)], dtype="object"), "array<string>")
    cuts = solved.select("id", F.explode(F.arrays_zip("own", sliced("own.signature", "script").alias("cut"))).alias("x"))
    cuts = cuts.select(F.col("id").alias("id_"), F.col("x.own.part").alias("part_"), F.col("x.own.block").alias("block_"), F.col("x.cut").alias("cut"))
    text = F.pandas_udf(lambda roles, texts, script: pd.Series([_repaired(r, t, s) for r, t, s in zip(roles, texts, script, strict=True)], dtype="object"), "string")
    done = pieces.join(cuts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("part") == F.col("part_")) & (F.col("block") == F.col("block_")))
    done = materialize(done.select("id", "part", "block", text("roles", "texts", "cut").alias("repaired")), "repaired")
    release(pieces)
    release(whole)

    digests = done.repartition(n, "id").sortWithinPartitions("id", "part", "block").select("id", "repaired").mapInArrow(_digests, f"id {kind}, sha256 string")
    digests = digests.select(F.col("id").alias("id_"), "sha256")
    audit = F.translate(F.col("script"), "uaUA", "RRII")
    out = solved.join(digests, F.col("id").eqNullSafe(F.col("id_")))
    return out.select("id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), F.col("sha256").alias("repaired_sha256")), done


def damage(df: DataFrame) -> DataFrame:
    """conversations rows with the faults that their crc32 names; copy is 1 for a repeated row.

    By crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes out [.!?], 3 repeats it,
    4 sets the role to user. A null counts as one space, in the key as in role and text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    new = {"role": F.when(case == 4, "user").otherwise(blank("role")), "text": text, "copy": F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))}
    return add_columns(df.where(case != 0), new)


def repair_damaged(df: DataFrame) -> DataFrame:
    """One row for every conv_id of df, after damage(): counts, cost, audit and digest of the cheapest repair.

    Extra columns are not read. A conversation whose rows are all dropped has zeros, an empty audit and the
    digest of the empty string; an empty table gives no rows.
    """
    rows = df.select("conv_id", "turn", "role", "text")
    found, _ = repair(damage(rows), copy_col="copy")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
