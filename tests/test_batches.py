"""Rows that tasks turn into Python objects are few at a time."""

import pandas as pd
import pyarrow as pa

from colloquy.functions.json import parse_line_edits
from colloquy.operators.prompts import _aligned


def test_answers_are_parsed_few_at_a_time():
    answers = pd.Series(['ok [{"i": 1, "text": "x"}]', None] * 1000)
    parts = list(parse_line_edits.func(iter([answers, answers[:0]])))
    assert max(map(len, parts)) <= 200 and [x for p in parts for x in p] == [[{"line": 1, "new_text": "x"}], []] * 1000


def test_utterances_are_aligned_few_at_a_time():
    n = 1001
    words = [[{"w": "one", "start_ms": 5, "end_ms": 9}] if i % 2 else None for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["One, two" if i else None for i in range(n)]), pa.array(words), pa.array([5] * n), pa.array([20] * n)], ["utterance_id", "text", "words", "start_ms", "end_ms"])
    parts = list(_aligned(iter([batch])))
    assert max(p.num_rows for p in parts) <= 200
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["utterance_id"] for r in rows] == list(range(n)) and rows[0]["tokens"] == []
    assert rows[1]["tokens"] == [{"token": "One,", "start_ms": 5, "end_ms": 9}, {"token": "two", "start_ms": 9, "end_ms": 20}]
