"""Secret scans with DataFrame functions only: fixed patterns and a randomness test battery.

Beside three kinds of patterns, every run of 20 or more token characters that holds a digit is a
candidate for kind ``random``. Its alphabet is inferred (hex, base32, base36, base62, base64, base64url);
chi-squared uniformity over that alphabet, a runs test about its middle and the lag-1 serial
correlation each give a p-value of the hypothesis that the token is random. Benjamini-Hochberg over all
candidates of the table, weighted by 1 / length (short tokens have less power), rejects it for tokens
that are text or counters. The error that it bounds is the share of random tokens among the rejected ones,
the secrets that the battery loses: at most ``fdr``. The rest, if they can hold ``min_bits`` bits, are reported.
Tokens under a pattern's span are tested too: ``n_confirmed`` counts the pattern spans that hold a random one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import materialize

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Pattern of the whole token and alphabet, the first that fits; each needs a letter and a digit, the last three both cases.
_MIXED = "(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
ENCODINGS = [
    ("(?=.*[a-f])[0-9a-f]+", _DIGITS + "abcdef"),
    ("(?=.*[A-F])[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+", _UPPER + "234567"),
    ("(?=.*[a-z])[a-z0-9]+", _LOWER + _DIGITS),
    ("(?=.*[A-Z])[A-Z0-9]+", _UPPER + _DIGITS),
    (_MIXED + "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    (_MIXED + "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    (_MIXED + "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
]
_SPANS = "array<struct<start: bigint, rank: int, end: bigint>>"
_BINS = 4000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _scan(values: Column, combine: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """The running combination of an array's values, by doubling steps: n log n work for n values."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def step(held: Column, j: Column) -> Column:
        behind = F.slice(F.concat(F.array_repeat(neutral, F.pow(F.lit(2.0), j).cast("int")), held), F.lit(1), F.size(held))
        return F.zip_with(held, behind, lambda x, y: combine(x, y))

    return F.aggregate(steps, values, step)


def _places(matches: Column, parts: Column) -> Column:
    """(start, end, match) of each match, from the lengths of the matches and of what lies between them."""

    def of(m: Column, p: Column) -> Column:
        gaps = F.transform(m, lambda _, i: (F.length(F.get(p, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long"))
        starts = _let(gaps, lambda g: _scan(g, lambda x, y: x + y, F.lit(0).cast("long")))
        return F.zip_with(m, starts, lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("match")))

    return _let(matches, lambda m: _let(parts, lambda p: of(m, p)))


def _meets(spans: Column, others: Column) -> Column:
    """For each of spans (start, end), in their order by start, whether one of others overlaps it: one sort and two scans."""
    far = F.lit(2**62)
    tagged = lambda x, own: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"))
    every = F.array_sort(F.concat(F.transform(spans, lambda x: tagged(x, True)), F.transform(others, lambda x: tagged(x, False))))

    def of(e: Column) -> Column:
        ends = _scan(F.transform(e, lambda x: F.when(x["own"], F.lit(-1).cast("long")).otherwise(x["end"])), F.greatest, F.lit(-1).cast("long"))
        starts = F.reverse(_scan(F.reverse(F.transform(e, lambda x: F.when(x["own"], far).otherwise(x["start"]))), F.least, far))
        hit = F.zip_with(F.zip_with(e, ends, lambda x, m: F.struct(x.alias("x"), (m > x["start"]).alias("hit"))), starts, lambda y, m: F.struct(y["x"]["own"].alias("own"), (y["hit"] | (m < y["x"]["end"])).alias("hit")))
        return F.transform(F.filter(hit, lambda y: y["own"]), lambda y: y["hit"])

    return _let(every, of)


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0 (Abramowitz & Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _tail(z)).otherwise(1 - _tail(-z))


def _both(z: Column) -> Column:
    return 2 * _tail(F.abs(z))


def _battery(token: Column, alphabet: Column) -> Column:
    """Bonferroni's combination of the three p-values of randomness; linear in the token, but for one replacement for each letter of the alphabet."""
    k = F.length(alphabet).cast("double")
    n = F.length(token).cast("double")
    halves = F.coalesce(*[F.when(alphabet == a, F.lit("L" * (len(a) // 2) + "H" * (len(a) - len(a) // 2))) for a in sorted({a for _, a in ENCODINGS})])
    squares = _sum(F.transform(F.split(alphabet, ""), lambda c: F.when(c == "", F.lit(0.0)).otherwise(F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))))
    df = k - 1
    p_chi = _let(squares * k / n - n, lambda chi: _upper((F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))))
    p_runs = _let(F.call_function("translate", token, alphabet, halves), lambda s: _runs(n, F.length(F.replace(s, F.lit("L"), F.lit(""))).cast("double"), F.length(F.regexp_replace(s, "H+|L+", "x")).cast("double")))
    values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))
    p_serial = _let(values, lambda v: _let(_sum(v) / n, lambda mean: _let(F.transform(v, lambda x: x - mean), lambda d: _serial(d, n))))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _runs(n: Column, n1: Column, runs: Column) -> Column:
    """Wald and Wolfowitz's test of the number of runs about the middle of the alphabet."""
    mean = 2 * n1 * (n - n1) / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(variance <= 0, F.lit(0.0)).otherwise(_both((runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-12)))))


def _serial(d: Column, n: Column) -> Column:
    """The lag-1 correlation of the deviations d from their mean, whose expectation is -1 / n."""
    after = F.slice(d, F.lit(2), F.size(d))
    before = F.slice(d, F.lit(1), F.size(d) - 1)
    own = _sum(F.transform(d, lambda x: x * x))
    return _let(own, lambda o: F.when(o <= 0, F.lit(0.0)).otherwise(_both((_sum(F.zip_with(before, after, lambda a, b: a * b)) / F.greatest(o, F.lit(1e-12)) + 1 / n) * F.sqrt(n))))


def _matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with the places of the pattern in column t; texts without a match are read once."""
    df = df.withColumn("__m", F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)))
    found = F.when(F.size("__m") > 0, _places(F.col("__m"), F.split("__t", pattern, -1)))
    return df.withColumn(name, found).drop("__m")


def _spans(places: Column, rank: int) -> Column:
    return F.coalesce(F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))), F.array()).cast(_SPANS)


def scan(df: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), fdr: float = 0.05, min_bits: float = 80.0) -> DataFrame:
    """A row for each row of df: id_cols; spans, an array of (start, kind, end) in code points, end exclusive; n_confirmed; tests.

    Spans are ordered by start, then by kind as in KINDS. A null text counts as empty; a text without a
    secret has an empty array; repeated rows each get their spans. A random token that overlaps a span of
    a pattern is not reported again, but counted in n_confirmed. tests (start, end, n, k, p, free) holds every token
    that the battery saw, in order; free says that no pattern's span overlaps it. Other columns of df don't matter.
    """
    src = df.select(*[F.col(f"`{c}`") for c in id_cols], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t"))
    for name, pattern in (("__assign", _ASSIGN), ("__access", _ACCESS), ("__hex", _HEX), ("__token", _TOKEN)):
        src = _matches(src, name, pattern)
    assigned = F.filter("__assign", lambda x: F.length(F.regexp_extract(x["match"], _ASSIGN, 1)) >= 8)
    base = F.array_sort(F.concat(_spans(assigned, 0), _spans(F.col("__access"), 1), _spans(F.col("__hex"), 2)))

    def candidate(x: Column) -> Column:
        alphabet = F.coalesce(*[F.when(x["match"].rlike(f"^(?:{p})$"), F.lit(a)) for p, a in ENCODINGS])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), alphabet.alias("alphabet"))

    fit = F.filter(F.transform("__token", candidate), lambda x: x["alphabet"].isNotNull())
    src = src.select(*id_cols, base.alias("__base"), fit.alias("__fit"))
    of = lambda x, hit: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.length(x["match"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), _battery(x["match"], x["alphabet"]).alias("p"), (~hit).alias("free"))
    tested = _let(F.col("__fit"), lambda fit: _let(F.col("__base"), lambda base: F.zip_with(fit, _meets(fit, base), of)))
    src = materialize(src.select(*id_cols, "__base", F.when(F.size("__fit") > 0, tested).alias("__tested")), "secrets")
    least = _threshold(src, fdr)
    random = lambda x: (x["p"] * x["n"] > F.lit(least)) & (x["n"] * F.log2(x["k"]) >= min_bits)
    found = F.filter("__tested", random)
    every = F.array_sort(F.concat("__base", _spans(F.filter(found, lambda x: x["free"]), 3)))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    confirmed = F.when(F.size(found) > 0, F.size(F.filter(_meets(F.col("__base"), found), lambda x: x)).cast("long")).otherwise(F.lit(0).cast("long"))
    return src.select(*id_cols, spans.alias("spans"), confirmed.alias("n_confirmed"), F.coalesce("__tested", F.array().cast(src.schema["__tested"].dataType)).alias("tests"))


def _threshold(tested: DataFrame, fdr: float) -> float:
    """The weighted Benjamini-Hochberg bound on p * n, from counts in fixed bins of its logarithm: a bounded result."""
    rows = tested.select(F.explode("__tested").alias("x")).select((F.col("x.p") * F.col("x.n")).alias("w"), (1 / F.col("x.n")).alias("inverse"))
    bins = rows.withColumn("bin", F.when(F.col("w") <= 0, F.lit(_BINS)).otherwise(F.least(F.lit(_BINS), F.greatest(F.lit(0), F.floor((10 - F.ln(F.greatest("w", F.lit(1e-300)))) * 10).cast("int")))))
    counts = sorted(((r.bin, r.c, r.s) for r in bins.groupBy("bin").agg(F.count("*").alias("c"), F.sum("inverse").alias("s")).collect()), reverse=True)
    total, mean = sum(c for _, c, _ in counts), sum(s for _, _, s in counts)
    if not total:
        return 0.0
    mean /= total
    best, below = 0.0, 0
    for b, c, _ in counts:
        below += c
        upper = math.exp(10 - b / 10)  # of the bin's values of p * n
        if b < _BINS and upper * mean <= fdr * below / total:
            best = upper
        elif b == _BINS:
            best = max(best, 0.0)
    return best
