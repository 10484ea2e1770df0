"""Scalar functions on names and texts, as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_form(x: Column | str) -> Column:
    """Lower case, trailing version parts dropped, separators as one underscore."""
    bare = F.regexp_replace(F.lower(F.trim(_c(x))), r"([._-]v?[0-9]+(\.[0-9]+)*)+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\s._-]+", "_"), "^_+|_+$", "")


def token_set(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(_c(x), "_"), lambda t: t != ""))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = token_set(a), token_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def levenshtein_bounded(a: Column | str, b: Column | str, most: int) -> Column:
    """The edit distance, or most + 1 if it is larger."""
    d = F.levenshtein(_c(a), _c(b), most)
    return F.when(d < 0, most + 1).otherwise(d)


def deletions(x: Column | str, most: int = 2) -> Column:
    """The string and all that one or two deletions (or one at most) leave: strings within two edits (or one) share one of these."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    one = less(_c(x))
    if most == 1:
        return F.array_distinct(F.concat(F.array(_c(x)), one))
    return F.array_distinct(F.concat(F.array(_c(x)), one, F.flatten(F.transform(one, less))))


def trigrams(x: Column | str) -> Column:
    padded = F.concat(F.lit("  "), _c(x), F.lit("  "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def trigram_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of the trigram counts of two strings; an array expression, so no shuffle."""
    x, y = trigrams(a), trigrams(b)
    count = lambda xs, g: F.size(F.filter(xs, lambda t: t == g)).cast("double")
    dot = lambda p, q: F.aggregate(F.transform(F.array_distinct(p), lambda g: count(p, g) * count(q, g)), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


#: Fixed patterns of personal data, applied in this order, each to what the one before has left.
PII = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "credit_card": r"(?:\d[ -]?){13,19}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "api_token": r"\b(?:sk|pk|ghp|ls)_[A-Za-z0-9_]{16,}\b|\bAKIA[0-9A-Z]{16}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]+?\.[A-Za-z0-9_-]+?\.[A-Za-z0-9_-]+\b",
    "phone": r"\+?\d{1,3}[ -.]?\(?\d{2,4}\)?[ -.]?\d{3,4}[ -.]?\d{3,4}",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
}


#: What a text must hold for a pattern to match at all; a plain search spares most texts the pattern.
_SIGN = {"email": ["@"], "ssn": ["-"], "api_token": ["_", "AKIA"], "jwt": ["eyJ"], "ipv4": ["."], "ipv6": [":"]}
#: Fixed names of fields whose values go whole.
BLOCKED = ("password", "auth_token", "api_key", "authorization", "session_token", "private_key", "client_secret", "credentials", "bearer_token")


def redact_text(x: Column | str, extra: tuple = ()) -> Column:
    """Personal data replaced, then each of `extra`, functions of a column (a recogniser of names, say)."""

    def one(c: Column, name: str, pattern: str) -> Column:
        done = F.regexp_replace(c, pattern, f"[redacted:{name}]")
        sign = _SIGN.get(name)
        return done if sign is None else F.when(reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in sign]), done).otherwise(c)

    return reduce(lambda c, f: f(c), extra, reduce(lambda c, kv: one(c, *kv), PII.items(), _c(x)))


SPAN = "struct<start: int, content: string, label: string>"


def spans(x: Column | str, pattern: str, label: str) -> Column:
    """A detector: where a pattern (which takes at least a character) matches, from the lengths of what lies between matches."""
    c = _c(x)
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    step = lambda s, m: F.struct(
        (s["at"] + F.length(m["gap"]) + F.length(m["content"])).alias("at"),
        F.array_append(s["all"], F.struct((s["at"] + F.length(m["gap"])).cast("int").alias("start"), m["content"].alias("content"), F.lit(label).alias("label"))).cast(f"array<{SPAN}>").alias("all"),
    )
    pairs = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))).alias("gap"), found.alias("content"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("all")), step, lambda s: s["all"])


def redact_spans(x: Column | str, *detected: Column) -> Column:
    """A text without the spans of any detectors (columns of array<SPAN>, of spans() or of a recogniser of the user's).

    The longest go first, equal ones by their start and then by the detectors' order; each replaces the first occurrence of its
    content in what is left, and one whose content is no longer there, as a longer one has covered it, changes nothing.
    Null detectors find nothing; a null text stays null.
    """
    ranked = [F.transform(F.coalesce(d, F.array().cast(f"array<{SPAN}>")), lambda s, k=k: F.struct((-F.length(s["content"])).alias("size"), s["start"].alias("start"), F.lit(k).alias("rank"), s["content"].alias("content"), s["label"].alias("label"))) for k, d in enumerate(detected)]
    every = F.filter(F.array_sort(F.concat(*ranked)), lambda s: s["size"] < 0)

    def put(out: Column, s: Column) -> Column:
        at = F.position(s["content"], out)
        return F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), F.lit("[redacted:"), F.lower(s["label"]), F.lit("]"), F.substring(out, at + F.length(s["content"]), F.length(out)))).otherwise(out)

    return F.aggregate(every, _c(x), put)


def dedup_key(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_ ]", ""), " +", " "))


def short_id(x: Column | str) -> Column:
    return F.substring(F.regexp_replace(_c(x), "^inv-", ""), 1, 8)


def yaml_escape(x: Column | str) -> Column:
    c = _c(x)
    return F.when(c.rlike("[:#\\n\"']"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def sampling_roll(x: Column | str) -> Column:
    """A number in [0, 1] that depends on the id only."""
    return F.conv(F.substring(F.sha1(_c(x)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


#: Fixed words that make a description hard to read.
JARGON = ("predicate", "smt", "z3", "temporal logic", "first-order", "forall", "exists(", "isolation forest", "prefixspan")


def clarity(x: Column | str) -> Column:
    """How readable a rule's description is, from 0 to 1."""
    d = F.trim(_c(x))
    n = F.length(d)
    has = reduce(lambda a, b: a | b, [F.contains(F.lower(d), F.lit(t)) for t in JARGON])
    score = F.lit(1.0) - F.when(n < 25, 0.4).when(n > 200, 0.2).otherwise(0.0) - F.when(d.rlike("`[^`]+`") | d.rlike("[0-9]"), 0.0).otherwise(0.2) - F.when(has, 0.3).otherwise(0.0)
    return F.when(F.coalesce(_c(x), F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def duration_ms(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / 1000)).cast("long")


def api_key_hash(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)
