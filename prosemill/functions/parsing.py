"""JSON objects within free text, and the header fields of plain-text books."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def balanced(text: str, start: int) -> str | None:
    """The object that opens at text[start], to its closing brace; braces within strings don't count. None if it never closes."""
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def json_object(text: str | None) -> str | None:
    """The first JSON object of a text, in its shortest form with sorted keys: the whole text, else what code fences hold, else what parses from the first brace on that can. None if there is none."""
    t = (text or "").strip()
    for part in (t, *(m.strip() for m in _FENCE.findall(t))):
        try:
            found = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    at, decoder = t.find("{"), json.JSONDecoder()
    while at >= 0:  # a try ends at the first character that can't be JSON
        try:
            return json.dumps(decoder.raw_decode(t, at)[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            at = t.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def json_objects(texts: pd.Series) -> pd.Series:
    return pd.Series([json_object(t) for t in texts], dtype=object)


def header_field(text: Column, name: str) -> Column:
    """A field of a book's header (Title: ..., with following indented lines), blanks folded; null if it has none."""
    found = F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(\S[^\n]*(?:\n[ \t]+\S[^\n]*)*)", 1)
    folded = F.trim(F.regexp_replace(found, r"\s+", " "))
    return F.when(folded != "", folded)
