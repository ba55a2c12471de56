"""The first JSON object in a text that has other things around it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import column

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)


def objects(text: str) -> Iterator[dict]:
    """Objects that begin at a brace, in order; the decoder finds where each ends."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            yield decoder.raw_decode(text, at)[0]
        except (ValueError, RecursionError):
            pass
        at = text.find("{", at + 1)


def first_object(text: str | None) -> str | None:
    """Fenced blocks first, then the text from each of its braces on; as compact JSON, null if none is an object."""
    if not text:
        return None
    for block in _FENCE.finditer(text):
        try:
            found = json.loads(block[1].strip())
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    found = next(objects(text), None)
    return None if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":"))


def object_text(c: Column | str) -> Column:
    """JSON text of the first object; texts that are one themselves are parsed in the JVM and never leave it."""

    @F.pandas_udf(StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    given = column(c)
    own = F.try_parse_json(given)
    clean = F.when(given.rlike(r"^\s*\{") & own.isNotNull(), F.to_json(own))
    # A conditional does not spare a Python column its work, so the texts that need none are passed as null.
    return F.coalesce(clean, scan(F.when(clean.isNull(), given)))
