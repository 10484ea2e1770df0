"""JSON payloads of any depth: blocked fields, limits of texts and lists. One pass over the tokens, without recursion.

A payload that is no valid JSON is walked as far as its tokens go, and never fails a task. They are sent to Python a
hundred at a time, not in batches of 10,000: payloads may be long.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulequarry.functions.text import BLOCKED

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\],:]|[^{}\[\],:"\s]+|\s+', re.S)
_KEY = re.compile("|".join(BLOCKED), re.I)
HIDDEN = '"[redacted:blocked_field]"'


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _end_of_value(tokens: list[str], k: int) -> int:
    """The place after the value that starts at token k (or after white space there)."""
    while k < len(tokens) and tokens[k].isspace():
        k += 1
    depth = 0
    while k < len(tokens):
        t = tokens[k]
        if t in "{[":
            depth += 1
        elif t in "}]":
            if not depth:
                return k  # no value
            depth -= 1
        elif t == "," and not depth:
            return k
        k += 1
        if not depth:
            return k
    return k


def redact_json(text: str | None) -> str | None:
    """The text with the values of blocked keys (in any case) replaced, whatever they hold; all else stays as it is written."""
    if text is None or not _KEY.search(text):
        return text
    tokens, out, k = _tokens(text), [], 0
    while k < len(tokens):
        t = tokens[k]
        out.append(t)
        k += 1
        if t[0] != '"' or not _is_blocked(t):
            continue
        at = k
        while at < len(tokens) and tokens[at].isspace():
            at += 1
        if at < len(tokens) and tokens[at] == ":":
            at += 1
            start = at
            while start < len(tokens) and tokens[start].isspace():
                start += 1
            end = _end_of_value(tokens, start)
            if end > start:
                out += tokens[k:start] + [HIDDEN]
                k = end
    return "".join(out)


def _is_blocked(token: str) -> bool:
    try:
        name = json.loads(token)
    except ValueError:
        name = token.strip('"')
    return name.lower() in BLOCKED


def truncate_json(text: str | None, chars: int, items: int) -> str | None:
    """The text with strings over `chars` characters cut and marked by …, and lists and objects of over `items` entries shortened, at every depth.

    White space between tokens goes; keys are kept whole.
    """
    if text is None:
        return None
    out: list[str] = []
    levels: list[int] = []  # entries that the open lists and objects have so far
    tokens = [t for t in _tokens(text) if not t.isspace()]
    k = 0
    while k < len(tokens):
        t = tokens[k]
        if t == "," and levels:
            levels[-1] += 1
            if levels[-1] >= items:  # on to the end of this level
                depth = 0
                while k < len(tokens) and (depth or tokens[k] not in "}]"):
                    depth += (tokens[k] in "{[") - (tokens[k] in "}]")
                    k += 1
                continue
        elif t in "{[":
            levels.append(0)
        elif t in "}]":
            if levels:
                levels.pop()
        elif t[0] == '"' and not (k + 1 < len(tokens) and tokens[k + 1] == ":"):
            t = _cut(t, chars)
        out.append(t)
        k += 1
    return "".join(out)


def _cut(token: str, chars: int) -> str:
    if len(token) <= chars + 2:
        return token
    try:
        value = json.loads(token, strict=False)
    except ValueError:
        return token
    return json.dumps(value[:chars] + "…", ensure_ascii=False) if len(value) > chars else token


def redacted(x: Column) -> Column:
    return F.udf(redact_json, "string", useArrow=False)(x)


def truncated(x: Column, chars: int, items: int) -> Column:
    return F.udf(lambda text: truncate_json(text, chars, items), "string", useArrow=False)(x)


#: What a compact step keeps beside its type, where it has it, and the length of its texts.
STEP_KEYS, STEP_CHARS = ("content", "tool", "args", "latency_ms", "result_status"), 240


def compact_steps(steps: str, fields: tuple[str, ...]) -> Column:
    """An array of steps (with these fields) as JSON: type and the five keys, absent ones left out, texts cut at 240 characters and marked."""
    cut = lambda s, c: F.when(F.length(s[c]) > STEP_CHARS, F.concat(F.substring(s[c], 1, STEP_CHARS), F.lit("…"))).otherwise(s[c])
    texts = ("content", "tool", "args", "result_status")
    return F.to_json(F.transform(steps, lambda s: F.struct(s["type"].alias("type"), *[(cut(s, c) if c in texts else s[c]).alias(c) for c in STEP_KEYS if c in fields])))
