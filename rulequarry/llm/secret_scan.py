"""Secret scans: fixed patterns, and a battery of randomness tests over runs of encoding characters.

Everything is built of SQL functions. A run of 20 or more of `[A-Za-z0-9+/_-]` has as its encoding the
narrowest of hex, base 32, lower-case base 36, base 62 and base 64 that holds it, of k characters. It is a
candidate unless it lacks upper case, lower case or digits where its encoding has them and a uniform run of its
length would lack them less than once in 500 times (so digits must be there from 20 characters in base 36, 30 in
base 32, 36 in base 62 and 38 in base 64). Three tests look for departures from independent uniform draws:

* chi-squared of the character counts against n/k, less its mean k-1 over its deviation;
* the number of runs of one class (upper, lower, digit or sign), against its mean and deviation
  given the class sizes;
* serial correlation at lag one of the characters' places in the alphabet.

Each statistic becomes a p-value by the normal tail, and twice their sum of logs by Fisher's rule
(chi-squared of six degrees, in closed form) the candidate's p. A candidate whose uniformity is
rejected is ordinary text. Rejections follow Benjamini and Hochberg within each class of length
(20-23, 24-31, 32-47, 48 and more), because short runs have little power; p is held on a grid
of 1/10000, so the ranks come from one bounded count table whatever the input's size. What is not
rejected, and has the least bits of entropy for its length, is a secret of kind `random`.

Null and empty texts have no spans. Repeated rows are scanned and ranked one by one. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns, and the least length of what they must hold.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RANDOM = "[A-Za-z0-9+/_-]{20,}"
ALPHA = 0.05
#: Least entropy of a run, as a share of the most that its length and alphabet allow.
MIN_ENTROPY = 0.72
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-",
}

#: What each encoding holds, narrowest first.
ENCODINGS = {"hex": "^[0-9a-f]+$", "base32": "^[A-Z2-7]+$", "base36": "^[0-9a-z]+$", "base62": "^[0-9A-Za-z]+$", "base64": "^[A-Za-z0-9+/_-]+$"}
#: A class of characters must be there if a uniform run lacks it less often than this.
MISS = 0.002


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, kind: str, keep: str = "true") -> Column:
    """All leftmost matches as (start, end, kind, hit), null where none; a match's place follows from the lengths of the pieces between matches."""
    p = _literal(pattern)
    return F.expr(f"""
        CASE WHEN text RLIKE {p} THEN
          filter(
            aggregate(
              arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0)),
              named_struct('at', 0L, 'out', CAST(array() AS array<struct<start: bigint, end: bigint, kind: string, hit: string>>)),
              (s, x) -> IF(x.`1` IS NULL, s, named_struct(
                'at', s.at + length(x.`0`) + length(x.`1`),
                'out', concat(s.out, array(named_struct('start', s.at + length(x.`0`), 'end', s.at + length(x.`0`) + length(x.`1`), 'kind', '{kind}', 'hit', x.`1`))))),
              s -> s.out),
            x -> {keep})
        END""")


def _tail(z: str) -> str:
    """Two-sided tail of the normal law for z >= 0 (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911D * {z} / 1.4142135623730951D))"
    poly = f"{t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D))))"
    return f"greatest(1e-12D, least(1D, {poly} * exp(-{z} * {z} / 2)))"


_STEPS = [
    {
        "encoding": "CASE " + " ".join(f"WHEN x.hit RLIKE '{v}' THEN '{k}'" for k, v in ENCODINGS.items()) + " END",
        "n": "CAST(length(x.hit) AS double)",
        "letters": "split(x.hit, '')",
        "classes": "split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x.hit, '[A-Z]', 'U'), '[a-z]', 'l'), '[0-9]', '9'), '[+/_-]', '-'), '')",
    },
    {"alphabet": "CASE x.encoding " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALPHABETS.items()) + " END"},
    {
        "k": "CAST(length(x.alphabet) AS double)",
        "codes": "transform(x.letters, c -> CAST(locate(c, x.alphabet) AS double))",
        "counts": "transform(array_distinct(x.letters), c -> CAST(size(filter(x.letters, y -> y = c)) AS double))",
        "class_counts": "transform(array_distinct(x.classes), c -> CAST(size(filter(x.classes, y -> y = c)) AS double))",
        "runs": "1D + aggregate(sequence(1, size(x.classes) - 1), 0D, (s, i) -> s + IF(x.classes[i] <> x.classes[i - 1], 1D, 0D))",
    },
    {
        "mean": "aggregate(x.codes, 0D, (s, y) -> s + y) / x.n",
        "squares": "aggregate(x.class_counts, 0D, (s, y) -> s + y * y)",
        "cubes": "aggregate(x.class_counts, 0D, (s, y) -> s + y * y * y)",
        "chi": "aggregate(x.counts, 0D, (s, y) -> s + y * y) * x.k / x.n - x.n",
        "entropy": "-aggregate(x.counts, 0D, (s, y) -> s + y / x.n * log2(y / x.n)) / log2(least(x.n, x.k))",
    },
    {
        "spread": "aggregate(x.codes, 0D, (s, y) -> s + (y - x.mean) * (y - x.mean))",
        "lagged": "aggregate(sequence(1, size(x.codes) - 1), 0D, (s, i) -> s + (x.codes[i] - x.mean) * (x.codes[i - 1] - x.mean))",
        "run_var": "(x.squares * (x.squares + x.n * (x.n + 1)) - 2 * x.n * x.cubes - x.n * x.n * x.n) / (x.n * x.n * (x.n - 1))",
    },
    {
        "z_chi": "greatest(0D, (x.chi - (x.k - 1)) / sqrt(2 * (x.k - 1) * (x.n - 1) / x.n))",
        "z_runs": "CASE WHEN x.run_var > 1e-9 THEN abs(x.runs - (x.n * (x.n + 1) - x.squares) / x.n) / sqrt(x.run_var) ELSE 0D END",
        "z_serial": "abs(CASE WHEN x.spread > 0 THEN (x.lagged / x.spread + 1 / x.n) * sqrt(x.n) ELSE sqrt(x.n) END)",
    },
    {"half": f"-(ln({_tail('x.z_chi')}) + ln({_tail('x.z_runs')}) + ln({_tail('x.z_serial')}))"},
    {"p": "least(1D, exp(-x.half) * (1 + x.half + x.half * x.half / 2))", "length_class": "CASE WHEN x.n < 24 THEN 0 WHEN x.n < 32 THEN 1 WHEN x.n < 48 THEN 2 ELSE 3 END"},
]
_KEPT = ("start", "end", "kind", "hit")


def _keep() -> str:
    """Whether a run has all classes that a uniform run of its encoding and length would lack less often than MISS."""
    cases = []
    for name, pattern in ENCODINGS.items():
        shares = [(c, sum(bool(re.match(c, x)) for x in ALPHABETS[name]) / len(ALPHABETS[name])) for c in ("[0-9]", "[a-z]", "[A-Z]")]
        needed = [f"(x.hit RLIKE '{c}' OR length(x.hit) < {math.ceil(math.log(MISS) / math.log(1 - q))})" for c, q in shares if 0 < q < 1]
        cases.append(f"WHEN x.hit RLIKE '{pattern}' THEN {' AND '.join(needed)}")
    return f"CASE {' '.join(cases)} END"


RANDOM_KEEP = _keep()


def battery(docs: DataFrame, out: str = "tested") -> DataFrame:
    """docs with an array of tested candidates: (start, end, kind, hit, encoding, n, z_chi, z_runs, z_serial, entropy, p, length_class)."""
    rows, names = docs.withColumn(out, _spans(RANDOM, "random", RANDOM_KEEP)), list(_KEPT)
    for step in _STEPS:
        fields = [f"'{n}', x.`{n}`" for n in names] + [f"'{n}', {e}" for n, e in step.items()]
        names += step
        rows = rows.withColumn(out, F.expr(f"transform(`{out}`, x -> named_struct({', '.join(fields)}))"))
    last = (*_KEPT, "encoding", "n", "z_chi", "z_runs", "z_serial", "entropy", "p", "length_class")
    return rows.withColumn(out, F.expr(f"transform(`{out}`, x -> named_struct({', '.join(f"'{n}', x.`{n}`" for n in last)}))"))


def limits(docs: DataFrame, alpha: float = ALPHA) -> dict[int, float]:
    """The largest p that Benjamini and Hochberg reject in each class of length; of a table of at most 4 x 10001 counts, four rows reach the driver."""
    counts = (
        battery(docs.select("text"))
        .select(F.explode("tested").alias("x"))
        .groupBy(F.col("x.length_class").alias("length_class"), F.ceil(F.col("x.p") * 10000).alias("cell"))
        .agg(F.count("*").alias("c"))
    )
    by_class = Window.partitionBy("length_class")
    ranked = counts.withColumns({"rank": F.sum("c").over(by_class.orderBy("cell")), "m": F.sum("c").over(by_class)})
    cut = ranked.filter(F.col("cell") / 10000.0 <= alpha * F.col("rank") / F.col("m")).groupBy("length_class").agg(F.max("cell").alias("cell"))
    return {r.length_class: r.cell / 10000 for r in cut.collect()}


def secret_scan(docs: DataFrame, alpha: float = ALPHA, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """docs (with a text) and an array `found` of (start, end, kind, hit), by start and then kind as listed: assign, access, hex, random.

    The p-value limits take a first pass over all texts. A random run that a fixed span overlaps is
    left out, as that place is marked already.
    """
    cut = limits(docs, alpha)
    reject = "CASE x.length_class " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in cut.items()) + " ELSE -1D END" if cut else "-1D"
    empty = "CAST(array() AS array<struct<start: bigint, end: bigint, kind: string, hit: string>>)"
    rows = battery(docs, "__tested").withColumns(
        {
            "__assign": _spans(ASSIGN, "assign", f"length(regexp_extract(x.hit, {_literal(ASSIGN)}, 1)) >= {ASSIGN_LEAST}"),
            "__access": _spans(ACCESS, "access"),
            "__hex": _spans(HEX, "hex"),
        }
    )
    rows = rows.withColumn("__fixed", F.expr(f"concat(coalesce(__assign, {empty}), coalesce(__access, {empty}), coalesce(__hex, {empty}))"))
    rows = rows.withColumn(
        "__random",
        F.expr(f"""
            transform(
              filter(coalesce(__tested, CAST(array() AS array<struct<start: bigint, end: bigint, kind: string, hit: string, encoding: string, n: double, z_chi: double, z_runs: double, z_serial: double, entropy: double, p: double, length_class: int>>)),
                x -> x.p > {reject} AND x.entropy >= {min_entropy}D AND NOT exists(__fixed, y -> y.start < x.end AND x.start < y.end)),
              x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'hit', x.hit))"""),
    )
    rank = "(CASE {0}.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END)"
    rows = rows.withColumn(
        "found",
        F.expr(f"array_sort(concat(__fixed, __random), (a, b) -> CASE WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) ELSE {rank.format('a')} - {rank.format('b')} END)"),
    )
    return rows.drop("__tested", "__assign", "__access", "__hex", "__fixed", "__random")


def digest(found: str = "found", fixed_only: bool = False) -> Column:
    """The spans as kind:start:end, joined by commas."""
    kept = f"filter(`{found}`, x -> x.kind <> 'random')" if fixed_only else f"`{found}`"
    return F.expr(f"array_join(transform({kept}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """secret_scan() with each stretch of text under one or more spans replaced by `mark`; null text stays null."""
    rows = secret_scan(docs)
    merged = """aggregate(found, named_struct('at', 0L, 'out', ''),
        (s, x) -> CASE WHEN x.end <= s.at THEN s
                       WHEN x.start < s.at THEN named_struct('at', x.end, 'out', s.out)
                       ELSE named_struct('at', x.end, 'out', concat(s.out, substring(text, CAST(s.at + 1 AS int), CAST(x.start - s.at AS int)), '%s')) END,
        s -> concat(s.out, substring(text, CAST(s.at + 1 AS int))))""" % mark.replace("\\", "\\\\").replace("'", "\\'")
    return rows.withColumn("text", F.expr(f"CASE WHEN size(found) > 0 THEN {merged} ELSE text END"))
