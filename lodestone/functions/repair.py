"""Text functions that need Python: JSON repair and character-sequence similarity, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions.text import tokens

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
CLOSERS = {"{": "}", "[": "]"}


def mended(text: str | None) -> str | None:
    """Canonical JSON from text that holds an object or array with common faults; null if there is none.

    Mends fences, text around, single quotes, bare line ends in strings, trailing commas and missing closers.
    """
    if not text:
        return None
    if fenced := FENCE.search(text):
        text = fenced[1]
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start < 0:
        return None
    for candidate in (text[start:], _rewritten(text[start:])):
        try:
            return json.dumps(json.JSONDecoder(strict=False).raw_decode(candidate)[0], sort_keys=True)
        except ValueError:
            continue
    return None


def _rewritten(text: str) -> str:
    out, stack, quote, k = [], [], "", 0
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\" and k + 1 < len(text):
                out.append(c + text[k + 1] if text[k + 1] != "'" else "'")
                k += 2
                continue
            if c == quote and (quote == '"' or not re.match(r"\w", text[k + 1 : k + 2])):
                quote = ""
                out.append('"')
            else:
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t", '"': '\\"'}.get(c, c))
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in CLOSERS:
            stack.append(CLOSERS[c])
            out.append(c)
        elif c in "}]":
            while out and out[-1].isspace() or out and out[-1] == ",":
                out.pop()
            if stack:
                stack.pop()
            out.append(c)
            if not stack:
                break
        else:
            out.append(c)
        k += 1
    if quote:
        out.append('"')
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()
    return "".join(out) + "".join(reversed(stack))


def _mend(texts: pd.Series) -> pd.Series:
    return texts.map(mended)


def repair_json(text: Column) -> Column:
    return pandas_udf(_mend, "string")(text)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def title_similarity(a: Column, b: Column, weight: float = 0.8) -> Column:
    """The larger of token overlap and weighted sequence ratio; rows with an overlap of weight or more skip the slow part."""
    fast = overlap(a, b)
    slow = lambda c: F.when(fast < weight, F.lower(c))
    return F.greatest(fast, weight * pandas_udf(_ratio, "double")(slow(a), slow(b)))
