"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Everything is a DataFrame expression. Tokens of 20 or more characters of an encoding's alphabet are
candidates. Their encoding (hex, base 32, base 64) is inferred, and three statistics are taken:
chi-squared against the uniform alphabet (as the rate of equal pairs), runs of one character class,
and the correlation of neighbouring symbols. Each is tested against the most random-looking
structured token of that encoding (names, words, paths, counters); the scores are combined as if they
were half correlated. A short token gives little evidence, and the false-discovery rate is
controlled by the Benjamini-Hochberg rule within each range of lengths over all candidates of the
corpus, so the score that is asked for depends on length. The rule needs only a histogram of scores,
whose size is fixed.

Defined results: a null or empty text has no spans; repeated rows give equal spans; of spans of the
method only those outside all base spans are added; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.session import cut, ready

# The base kinds in order and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Candidates, the symbols in order of their values, and the lengths that part the ranges.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
RANGES = (20, 28, 40, 64, 128)
#: Of each encoding: alphabet, and the structured tokens that look most random: rate of equal pairs, of
#: equal triples, of class changes, and correlation of neighbours.
ENCODINGS = {"hex": (16, 0.11, 0.016, 0.15, 0.35), "base32": (32, 0.07, 0.0065, 0.12, 0.35), "base64": (64, 0.062, 0.0055, 0.3, 0.35)}
RATE = 0.01
#: Scores are counted in bins of this width up to +-LAST bins.
BIN, LAST = 0.05, 400


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, token>> of the leftmost matches; start and end in code points."""
    # What lies between the matches and the matches themselves give every place.
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), token.alias("token"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        first = a["at"] + r["gap"]
        end = first + F.length(r["whole"])
        return F.when(r["whole"].isNull(), a).otherwise(F.struct(end.alias("at"), F.array_append(a["out"], F.struct(first.alias("start"), end.alias("end"), r["token"].alias("token"))).alias("out")))

    rows = F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["whole"].alias("whole"), r["token"].alias("token")))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(start["out"])


def _score(token: Column) -> Column:
    """The combined score of a token: large for what no structured token looks like."""
    known = {k: F.array(*(F.lit(float(x)) for x in v)) for k, v in ENCODINGS.items()}
    encoding = F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), known["hex"]).when(token.rlike("^[A-Z2-7]+$"), known["base32"]).otherwise(known["base64"])

    def tests(e: Column, v: Column) -> Column:
        n = F.size(v).cast("double")
        k, pair, triple, change, serial = (F.get(e, F.lit(i)) for i in range(5))
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0)))
        chi = k * squares / n - n
        equal = ((chi + n) * n / k - n) / (n * (n - 1))
        one = (pair - equal) / F.sqrt(2 * (pair - pair * pair) / (n * (n - 1)) + 4 * (triple - pair * pair) / n)
        kind = lambda x: F.when(x < 10, 0).when(x < 36, 1).when(x < 62, 2).otherwise(3)
        steps = F.sequence(F.lit(1), F.size(v) - 1)
        runs = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (kind(F.get(v, i)) != kind(F.get(v, i - 1))).cast("double"))
        two = (runs - change * (n - 1)) / F.sqrt((n - 1) * change * (1 - change))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lag = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
        three = F.when(spread > 0, (serial - F.abs(lag / spread)) * F.sqrt(n - 1) / (1 - serial * serial)).otherwise(-8.0)
        limited = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x)) for x in (one, two, three)]
        return sum(limited[1:], limited[0]) / math.sqrt(6)

    values = _let(F.filter(F.split(token, ""), lambda c: c != ""), lambda cs: F.transform(cs, lambda c: F.instr(F.lit(SYMBOLS), c) - 1))
    plain = token.rlike("^(?:[0-9]+|[a-z]+|[A-Z]+)$")
    return F.when(plain, F.lit(-9.0)).otherwise(_let(encoding, lambda e: _let(values, lambda v: tests(e, v))))


def _range(length: Column) -> Column:
    """Number of a length's range, from 0."""
    out = F.lit(0)
    for k, low in enumerate(RANGES[1:], 1):
        out = F.when(length >= low, k).otherwise(out)
    return out


def cutoffs(histogram: dict[tuple[int, int], int], rate: float = RATE) -> list[float]:
    """The least score of a discovery in each range, by Benjamini-Hochberg over a histogram of (range, bin) counts."""
    out = []
    for r in range(len(RANGES)):
        bins = sorted((b for q, b in histogram if q == r), reverse=True)
        total, above, least = sum(histogram[r, b] for b in bins), 0, math.inf
        for b in bins:
            above += histogram[r, b]
            if 0.5 * math.erfc(b * BIN / math.sqrt(2)) <= rate * above / total:
                least = b * BIN
        out.append(least)
    return out


def secret_spans(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array<struct<start, kind, end>> by start and kind (numbers of ``KINDS``) of every row."""
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    assign = F.transform(F.filter(_found(text, ASSIGN, 2), lambda m: F.length(m["token"]) >= LEAST_ASSIGN), span(0))
    access = F.transform(F.filter(_found(text, ACCESS), lambda m: m["end"] - m["start"] >= LEAST_ACCESS), span(1))
    hexes = F.transform(_found(text, HEX), span(2))
    told = docs.select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), _found(text, TOKEN).alias("tokens"))
    outside = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    told = told.select("doc_id", "base", outside.alias("tokens"))
    scored = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _range(t["end"] - t["start"]).alias("range"), F.floor(_score(t["token"]) / BIN).cast("int").alias("bin")))
    told = cut(told.select("doc_id", "base", scored.alias("tokens")))

    bins = told.select(F.explode("tokens").alias("t")).groupBy(F.col("t.range").alias("range"), F.least(F.greatest(F.col("t.bin"), F.lit(-LAST)), F.lit(LAST)).alias("bin")).count()
    least = F.array(*(F.lit(x) for x in cutoffs({(r["range"], r["bin"]): r["count"] for r in bins.collect()}, rate)))
    random = F.transform(F.filter("tokens", lambda t: t["bin"] * BIN >= F.get(least, t["range"]) - 1e-9), span(3))
    return told.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
