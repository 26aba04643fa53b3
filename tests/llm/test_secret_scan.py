import math
import random
import re
import string
import time

from pyspark.sql import functions as F

from provrank.llm.secret_scan import ENCODINGS, _meets, scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(t):
    t = t or ""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


def test_base_spans_equal_plain_regex(spark):
    r = random.Random(4)
    parts = ["token = ", "Password:'", "api_key=", "APIKEY : ", "secret=short", "tokens: abcdefgh", "é☃🙂 ", "AKIA" + "Z9" * 6, "AKIAAKIA1", "0123456789abcdef" * 2, "deadbeef" * 5, "token: secret: abcdefgh12", "\n", "x", " ", "aaaa", "=", '"', "abcdefgh1234"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 200_000, "token=" + "x" * 100_000, "f" * 64]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for row in scan(df).collect():
        got = [(s.start, s.kind, s.end) for s in row.spans if s.kind != "random"]
        assert got == base(texts[row.doc_id]), texts[row.doc_id]
    assert scan(df.limit(0)).count() == 0


def test_battery_tells_random_from_words(spark):
    r = random.Random(8)
    b62 = string.ascii_letters + string.digits
    real = ["".join(r.choice(b62) for _ in range(40)) for _ in range(120)]
    words = ["".join(r.choice(["the", "Data", "set", "Index", "run"]) for _ in range(11)) + str(r.randint(1, 9)) for _ in range(120)]
    texts = [f"see {x} now" for x in real + words] + ["plain prose without digits " * 30, "abcdefghijklmnopqrstuvwxyz" * 3, "a1" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = {x.doc_id for x in scan(df).collect() if any(s.kind == "random" and s.start == 4 and s.end == 44 for s in x.spans) or (x.doc_id >= 120 and x.spans)}
    assert sum(i < 120 for i in hit) >= 108
    assert sum(i >= 120 for i in hit) <= 6


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh1")], "doc_id long, text string")
    plan = scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def battery(token, alphabet):
    """The three tests by hand."""
    v, k, n = [alphabet.index(c) + 1 for c in token], len(alphabet), len(token)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum(v.count(x) ** 2 for x in set(v)) * k / n - n
    df = k - 1
    p = [upper((max(chi, 0) / df) ** (1 / 3) / math.sqrt(2 / (9 * df)) - (1 - 2 / (9 * df)) / math.sqrt(2 / (9 * df)))]
    high = [x > k / 2 for x in v]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * n1 * (n - n1) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p.append(2 * upper(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 0.0)
    m = sum(v) / n
    d = [x - m for x in v]
    own = sum(x * x for x in d)
    p.append(2 * upper(abs((sum(a * b for a, b in zip(d, d[1:], strict=False)) / own + 1 / n) * math.sqrt(n))) if own > 0 else 0.0)
    return min(1.0, 3 * min(p))


def planted(seed, count=60):
    r = random.Random(seed)
    kinds = [a for _, a in ENCODINGS]
    real = ["".join(r.choice(a) for _ in range(r.randint(30, 90))) for a in kinds for _ in range(count // 4)]
    text = ["".join(r.choice(["the", "Data", "set", "Index", "run"]) for _ in range(r.randint(7, 20))) + str(r.randint(1, 9)) for _ in range(count * 4)]
    return real, text


def test_battery_and_false_discovery_control_match_a_plain_version(spark):
    real, text = planted(3)
    rows = [(i, f"see {x} now") for i, x in enumerate(real + text)]
    found = {x.doc_id: x for x in scan(spark.createDataFrame(rows, "doc_id long, text string"), fdr=0.05).collect()}
    tests = []
    for i, x in enumerate(real + text):
        alphabet = next((a for p, a in ENCODINGS if re.fullmatch(p, x)), None)
        got = found[i].tests
        assert len(got) == (alphabet is not None and bool(re.search("[0-9]", x)))
        if got:
            p = battery(x, alphabet)
            assert got[0].start == 4 and got[0].end == 4 + len(x) and abs(got[0].p - p) < 1e-5
            tests.append((i, p, len(x), len(alphabet)))
    # weighted Benjamini-Hochberg over all of them; bins of the running bound are a tenth of its logarithm wide
    mean = sum(1 / n for _, _, n, _ in tests) / len(tests)
    order = sorted(tests, key=lambda t: t[1] * t[2])
    cut = max((j for j, t in enumerate(order, 1) if t[1] * t[2] * mean <= 0.05 * j / len(order)), default=0)
    rejected = {t[0] for t in order[:cut]}
    reported = {i for i, x in found.items() if any(s.kind == "random" for s in x.spans)}
    fits = {i for i, _, n, k in tests if n * math.log2(k) >= 80 and found[i].tests[0].free}  # a long run of lower-case hex is a pattern's span
    assert len((fits - rejected) ^ reported) <= 2
    assert len(rejected & set(range(len(real)))) <= 0.1 * len(rejected)
    tested = {t[0] for t in tests}
    assert len(reported & set(range(len(real)))) >= 0.9 * len(tested & fits & set(range(len(real))))
    assert len([i for i in reported if i >= len(real)]) <= 0.1 * len(reported)


def test_tokens_under_patterns_confirm_them(spark):
    r = random.Random(1)
    b62 = string.ascii_letters + string.digits
    token = "".join(r.choice(b62) for _ in range(48)) + "7"
    hexed = "".join(r.choice("0123456789abcdef") for _ in range(64))
    words = [(100 + i, x) for i, x in enumerate(planted(4)[1])]
    rows = [(1, f"token = {token} and {hexed}"), (1, f"token = {token} and {hexed}"), (2, "token = abcdefghabcdefghabcdefgh1"), (3, f"x {token} y"), *words]
    got = [x for x in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.doc_id < 100]
    assert sorted((x.doc_id, x.n_confirmed, [s.kind for s in x.spans]) for x in got) == [(1, 2, ["assign", "hex"]), (1, 2, ["assign", "hex"]), (2, 0, ["assign"]), (3, 0, ["random"])]


def test_overlap_equals_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for i in range(200):
        spans = lambda: sorted({(s, s + r.randint(1, 9)) for s in (r.randint(0, 60) for _ in range(r.randint(0, 12)))})
        rows.append((i, spans(), spans()))
    kind = "array<struct<start: bigint, end: bigint>>"
    got = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", _meets(F.col("a"), F.col("b")).alias("m")).collect()
    for x in got:
        _, a, b = rows[x.i]
        assert x.m == [any(s < f and t < e for t, f in b) for s, e in a]


def test_many_and_long_tokens_take_linear_time(spark):
    r = random.Random(2)
    runs = " ".join("".join(r.choice("0123456789abcdef") for _ in range(33)) for _ in range(8000))
    image = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(1_000_000))
    began = time.perf_counter()
    got = {x.doc_id: x for x in scan(spark.createDataFrame([(1, runs), (2, image)], "doc_id long, text string")).collect()}
    assert len(got[1].spans) == 8000 and all(s.start == 34 * k and s.end == 34 * k + 33 for k, s in enumerate(got[1].spans))
    assert [(s.start, s.end) for s in got[2].spans] == [(0, 1_000_000)]
    assert time.perf_counter() - began < 60
