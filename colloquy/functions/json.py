"""JSON out of model answers that may have prose around it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
SUMMARY = T.StructType([T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("action_items", _LIST), T.StructField("decisions", _LIST), T.StructField("topics", _LIST)])
EDITS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("new_text", T.StringType())]))

#: Answers that are parsed at once.
PARSED = 200


def first_block(text: str | None, marks: str = "{}") -> str | None:
    """The first balanced block between two marks; marks in strings do not count."""
    start = (text or "").find(marks[0])
    if start < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, start)
        return text[start:end]
    except ValueError:
        pass
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            skip, quoted = (False, True) if skip else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c in marks:
            depth += 1 if c == marks[0] else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def _strings(value) -> list[str]:
    """A list of strings as it is meant: blank ones go, one string is a list of one."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if not isinstance(value, list):
        return []
    return [x.strip() if isinstance(x, str) else json.dumps(x, separators=(",", ":")) for x in value if not isinstance(x, str) or x.strip()]


def summary_fields(text: str | None) -> dict:
    """The fields of a summary; text that holds no JSON object is the summary itself."""
    block = first_block(text)
    try:
        found = json.loads(block) if block is not None else None
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return {"title": None, "summary": (text or "").strip(), "action_items": [], "decisions": [], "topics": []}
    plain = {k: found[k].strip() or None if isinstance(found.get(k), str) else None for k in ("title", "summary")}
    return plain | {k: _strings(found.get(k)) for k in ("action_items", "decisions", "topics")}


@F.pandas_udf(SUMMARY)
def parse_summary(answers: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in answers:
        yield pd.DataFrame([summary_fields(x) for x in series], columns=["title", "summary", "action_items", "decisions", "topics"])


def line_edits(text: str | None) -> list[dict]:
    """The corrections ``{"i": line, "text": ...}`` in an answer; none if it holds no such array."""
    try:
        found = json.loads(first_block(text, "[]") or "[]")
    except ValueError:
        return []
    good = all(isinstance(x, dict) and type(x.get("i")) is int and x["i"] >= 0 and isinstance(x.get("text"), str) for x in found)
    return [{"line": x["i"], "new_text": x["text"]} for x in found] if good else []


@F.pandas_udf(EDITS)
def parse_line_edits(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in answers:
        # an answer holds all lines of a recording, so few are parsed at once
        for at in range(0, len(series), PARSED):
            yield pd.Series([line_edits(x) for x in series.iloc[at : at + PARSED]], dtype="object")


def array_field(document: Column, key: str) -> Column:
    """``document.key`` as an array of strings: null if absent or of another shape."""
    return F.from_json(F.get_json_object(document, f"$.{key}"), "array<string>")


def text_field(document: Column, key: str) -> Column:
    """A string field, blank ones null."""
    return F.nullif(F.trim(F.get_json_object(document, f"$.{key}")), F.lit(""))
