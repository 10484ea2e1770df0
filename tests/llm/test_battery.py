"""Each statistic of the randomness battery against its definition, and the false-discovery limits against a plain ranking."""

import itertools
import math
import random
import re
import string
from collections import Counter

from rulequarry.llm import secret_scan

UP, LOW, DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALPHABETS = {"hex": DIG + "abcdef", "base32": UP + "234567", "base36": DIG + LOW, "base62": DIG + UP + LOW, "base64": DIG + UP + LOW + "+/_-"}


def tail(z):
    return max(1e-12, min(1.0, math.erfc(z / math.sqrt(2))))


def run_moments(counts):
    """Mean and variance of the number of runs over all orders, from the chances that neighbours differ."""
    n = sum(counts)

    def chance(*classes):
        left, p = list(counts), 1.0
        for k, c in enumerate(classes):
            p *= left[c] / (n - k)
            left[c] -= 1
        return p

    kinds = range(len(counts))
    one = sum(chance(a, b) for a, b in itertools.product(kinds, repeat=2) if a != b)
    touching = sum(chance(a, b, c) for a, b, c in itertools.product(kinds, repeat=3) if a != b and b != c)
    apart = sum(chance(a, b, c, d) for a, b, c, d in itertools.product(kinds, repeat=4) if a != b and c != d)
    m = n - 1
    second = m * one + 2 * (m - 1) * touching + (m - 1) * (m - 2) * apart
    return 1 + m * one, second - (m * one) ** 2


def plain(hit):
    name = next(k for k, v in ALPHABETS.items() if set(hit) <= set(v))
    alphabet, n = ALPHABETS[name], len(hit)
    k, count = len(alphabet), Counter(hit)
    chi = sum((count[c] - n / k) ** 2 / (n / k) for c in alphabet)
    z_chi = max(0.0, (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    classes = ["U" if c in UP else "l" if c in LOW else "9" if c in DIG else "-" for c in hit]
    mean, var = run_moments(list(Counter(classes).values()))
    z_runs = abs(sum(1 for _ in itertools.groupby(classes)) - mean) / math.sqrt(var) if var > 1e-9 else 0.0
    codes = [alphabet.index(c) for c in hit]
    centre = sum(codes) / n
    spread = sum((y - centre) ** 2 for y in codes)
    r = sum((a - centre) * (b - centre) for a, b in zip(codes, codes[1:])) / spread
    z_serial = abs(r + 1 / n) * math.sqrt(n)
    half = -sum(math.log(tail(z)) for z in (z_chi, z_runs, z_serial))
    entropy = -sum(c / n * math.log2(c / n) for c in count.values()) / math.log2(min(n, k))
    return name, z_chi, z_runs, z_serial, entropy, min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def texts():
    rng = random.Random(12)
    runs = ["".join(rng.choice(a) for _ in range(rng.randrange(38, 70))) for a in ALPHABETS.values() for _ in range(8)]
    runs += ["camelCaseNameOfSomeLongMethod42AndMoreOfThem7", "aB3" * 16, "0123456789abcdef" * 3, "Aa0-" * 12]
    return [f"say {r} here" for r in runs] + [None, "", "short Ab1"]


def test_statistics(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    seen, got = set(), []
    for r in secret_scan.battery(rows).collect():
        for x in r.tested or []:
            assert r.text[x.start : x.end] == x.hit and re.fullmatch("[A-Za-z0-9+/_-]{20,}", x.hit)
            name, *want = plain(x.hit)
            assert x.encoding == name
            for value, expected in zip((x.z_chi, x.z_runs, x.z_serial, x.entropy), want):
                assert abs(value - expected) < 1e-9 * max(1, expected)
            assert abs(x.p - want[-1]) < 1e-5
            seen.add(name)
            got.append((x.length_class, math.ceil(x.p * 10000)))
    assert seen == set(ALPHABETS) and len(got) >= 40
    # the limit of each class: the largest cell whose rank allows it, by a plain ranking
    want = {}
    for c in {c for c, _ in got}:
        cells = [p for k, p in got if k == c]
        held = [p for p in cells if p / 10000 <= 0.05 * sum(q <= p for q in cells) / len(cells)]
        want |= {c: max(held) / 10000} if held else {}
    assert secret_scan.limits(rows, 0.05) == want and want
