"""Redaction of secret-like fields in JSON payloads, and truncation.

Objects are searched at every depth, lists aren't entered. JSON of unknown shape can't be rewritten by built-in
expressions, so this is the one Arrow-batched Python function here. The list of secret words is our own choice.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
SECRET = re.compile(r"(?i)password|passwd|secret|token(?!s)|api[_-]?key|authorization|credential|private[_-]?key|cookie")


def redact(value):
    if not isinstance(value, dict):
        return value
    return {k: REDACTED if SECRET.search(k) else redact(v) for k, v in value.items()}


def redact_json(c: Column) -> Column:
    """JSON text with secret values replaced; text that isn't an object stays."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or not SECRET.search(t):
                return t
            try:
                v = json.loads(t)
            except ValueError:
                return t
            return json.dumps(redact(v), separators=(",", ":"), ensure_ascii=False) if isinstance(v, dict) else t

        return texts.map(one, na_action="ignore")

    return run(c)


def bounded_json(c: Column, limit: int = 4_096) -> Column:
    """A JSON value, or the first characters of its serialised text as a JSON string where that text is longer.

    What counts is the text as serialised (a blank behind separators, ASCII escapes), which is at most seven times as long
    as what is stored: only values that may be too long go to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                text = json.dumps(json.loads(t))
            except ValueError:
                text = json.dumps(t)
            return t if len(text) <= limit else json.dumps(text[:limit])

        return texts.map(one, na_action="ignore")

    return F.when(F.length(c) * 7 > limit, run(c)).otherwise(c)


def truncate_json(c: Column, limit: int = 65_536) -> Column:
    return F.when(F.length(c) > limit, F.to_json(F.struct(F.lit(True).alias("truncated"), F.substring(c, 1, limit).alias("prefix")))).otherwise(c)
