"""Conversation repair against an exhaustive search, a plain program over whole strings, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from provrank.llm import conversation_repair as cr
from provrank.llm.queries import oracle_sql, op12_conversation_repair

PATTERN = re.compile(r"(s?(ua)+)?")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def exhaustive(rows, most_inserts=3):
    """Cheapest (cost, audit) over all ways to edit rows of (role initial, fault), trying every insert."""
    best = None
    choices = [[("D", "", 4)] if f >= 2 else [("D", "", 4), ("K", r, 3 * f), ("R", "u", 3 + 3 * f), ("R", "a", 3 + 3 * f)] for r, f in rows]
    slots = [""] + ["".join(x) for n in range(1, most_inserts + 1) for x in itertools.product("ua", repeat=n)]
    for picked in itertools.product(*choices):
        for gaps in itertools.product(slots, repeat=len(rows) + 1):
            out = gaps[0] + "".join(p[1] + g for p, g in zip(picked, gaps[1:], strict=True))
            if PATTERN.fullmatch(out):
                cost = sum(p[2] for p in picked) + 3 * sum(map(len, gaps))
                audit = "I" * len(gaps[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picked, gaps[1:], strict=True))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def plain(rows):
    """(cost, audit, lines) with whole strings for each state; rows: (role, text, fault)."""
    layer = {"": (0, "", ())}

    def inserted(layer):
        for _ in range(3):
            for state, (cost, audit, lines) in list(layer.items()):
                for role in "ua":
                    if (state, role) in NEXT:
                        new = (cost + 3, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[role]))
                        to = NEXT[state, role]
                        if to not in layer or new[:2] < layer[to][:2]:
                            layer[to] = new
        return layer

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in inserted(layer).items():
            options = [(state, 4, "D", ())]
            if fault < 2:
                options += [(NEXT[state, r], extra + 3 * fault, letter, (f"{name}:{text}",)) for r, extra, letter, name in ((role[:1], 0, "K", role), ("u", 3, "R", "user"), ("a", 3, "R", "assistant")) if (state, r) in NEXT]
            for to, extra, letter, line in options:
                new = (cost + extra, audit + letter, lines + line)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        layer = after
    return min(v for s, v in inserted(layer).items() if s in ("", "a"))


def faults(rows):
    """rows of (role, text) with their first fault."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append((role, text, 2 if not body else 3 if (role, text) in seen else 1 if body[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def damaged(df):
    out = {}
    for r in df.itertuples(index=False):
        blank = lambda v: " " if v is None or v != v else v
        number = lambda v: " " if v is None or v != v else str(int(v))
        case = zlib.crc32(f"{number(r.conv_id)}:{number(r.turn)}".encode()) % 20
        own = out.setdefault(None if r.conv_id is None or r.conv_id != r.conv_id else int(r.conv_id), [])
        if case == 0:
            continue
        role, text = blank(r.role), blank(r.text)
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        row = (r.turn == r.turn and r.turn is not None, r.turn if r.turn == r.turn and r.turn is not None else 0, "user" if case == 4 else role, text)
        own += [row] * (2 if case == 3 else 1)
    return {k: sorted(v, key=lambda r: (*r[:3], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest())) for k, v in out.items()}


def report(rows):
    marked = faults([r[2:] for r in rows])
    turns = {r[1] for r in rows if r[0]}
    kinds = [r[0][:1] for r in marked]
    cost, audit, lines = plain(marked)
    count = lambda f: sum(x[2] == f for x in marked)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count(2), count(3), count(1), sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(got, df):
    want = {k: report(v) for k, v in damaged(df).items()}
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_trie_finds_what_trying_everything_finds(n):
    signs = sorted(range(16))
    some = list(itertools.product(signs, repeat=n))
    random.seed(n)
    some = sorted(some if n < 2 else random.sample(some, 60 if n == 2 else 25))
    trie = cr.SignatureTrie()
    for row in some:
        signature = "".join(f"{x:x}" for x in row)
        *_, cost, script = trie.answer(signature)
        assert (cost, cr.audit_of(script)) == exhaustive([("suax"[x // 4], x % 4) for x in row], 2 if n == 3 else 3)


def test_trie_equals_the_plain_program_and_shares_layers():
    random.seed(2)
    some = sorted({"".join(random.choice("0123456789abcdef") for _ in range(random.randint(0, 12))) for _ in range(3000)})
    trie = cr.SignatureTrie()
    for s in some:
        *_, cost, script = trie.answer(s)
        assert (cost, cr.audit_of(script)) == plain([("suax"[int(x, 16) // 4], "t", int(x, 16) % 4) for x in s])[:2]
    assert trie.made == len({s[:k] for s in some for k in range(1, len(s) + 1)})
    with pytest.raises(ValueError):
        trie.insert("")


def test_given_table_equals_the_plain_version_and_sql(spark, small):
    got = op12_conversation_repair(spark, small)
    df = pd.read_parquet(f"{small}/conversations.parquet")
    check(got.collect(), df)
    conversations = df  # noqa: F841
    want = duckdb.sql(oracle_sql()["op12_conversation_repair"]).df()
    assert got.toPandas().sort_values("conv_id")[list(want.columns)].values.tolist() == want.sort_values("conv_id").values.tolist()


def test_large_conversation_in_many_pieces(spark):
    random.seed(3)
    rows = [(7, i, random.choice(["user", "assistant", "system", "tool", ""]), random.choice(["Yes.", "No!", f"Row {i}.", f"cut {i}", " \t"])) for i in range(1500)]
    rows += [(7, 3, "user", "x" * 400_000 + "."), (8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    check(cr.repair_damaged(df).collect(), df.toPandas())
    found, pieces = cr.repair(df)
    own = [r for r in pieces.orderBy("id", "part", "block").collect() if r.id == 7]
    assert len(own) > 5
    text = "\n".join(r.repaired for r in own if r.repaired is not None)
    assert hashlib.sha256(text.encode()).hexdigest() == found.where("id = 7").first().repaired_sha256
    assert PATTERN.fullmatch("".join(line[0] for line in text.split("\n")))


def test_nulls_ties_repeats_other_columns_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (2**60 + 1, 5, "user", None), (2**60 + 1, None, "assistant", "B?"), (2**60 + 1, 9, None, "C.")]
    rows += [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 1, "assistant", "Z."), (3, 2**60, "assistant", ""), (3, 2**60 + 2, "assistant", " ")]
    rows += [(k, t, r, x) for k in range(4, 60) for t, r, x in ((0, "user", "Q?"), (1, "assistant", "A."), (1, "assistant", "B"))]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, copy int, digest string, Cost int")
    plain_rows = pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("conv_id", "turn", "role", "text"))})
    check(cr.repair_damaged(df).collect(), plain_rows)
    assert cr.repair_damaged(df.limit(0)).collect() == []


def test_conversation_without_rows_after_damage(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "A.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in cr.repair_damaged(df).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
