"""Queries through prompts and answers: corrections, notes, marks in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import library, prompts
from .fixtures import oracle, table, view
from .folders import shared_folder
from .queries import query

# a stand-in for the model: it answers from the prompt alone.  Of each three lines it ends one with a word, gives the next two corrections that build
# on each other after one that is much too long, and leaves the last; every fifth recording gets no array, and some lines are not there.
_ANSWER = r"""CASE WHEN recording_id % 5 = 4 THEN 'nothing to fix' ELSE concat('Sure: ', to_json(concat(flatten(transform(split(lines, '\n(?=[0-9]+: )'), l ->
    CASE CAST(regexp_extract(l, '^([0-9]+): ', 1) AS INT) % 3
      WHEN 0 THEN array(named_struct('i', CAST(regexp_extract(l, '^([0-9]+): ', 1) AS INT), 'text', concat(' ', substring(l, instr(l, ': ') + 2), ' indeed ')))
      WHEN 1 THEN array(named_struct('i', CAST(regexp_extract(l, '^([0-9]+): ', 1) AS INT), 'text', repeat(substring(l, instr(l, ': ') + 2), 3)),
                        named_struct('i', CAST(regexp_extract(l, '^([0-9]+): ', 1) AS INT), 'text', concat('Well ', substring(l, instr(l, ': ') + 2))),
                        named_struct('i', CAST(regexp_extract(l, '^([0-9]+): ', 1) AS INT), 'text', concat('So well ', substring(l, instr(l, ': ') + 2))))
      ELSE array() END)), array(named_struct('i', 1000, 'text', 'not there')))), ' done') END"""


@query(
    oracle(
        r"""SELECT utterance_id, line, CASE WHEN fixed THEN CASE line % 3 WHEN 0 THEN concat(t, ' indeed') WHEN 1 THEN concat('So well ', t) ELSE text END ELSE text END AS text, fixed AND line % 3 < 2 AS edited
            FROM (SELECT *, recording_id % 5 <> 4 AND t <> '' AS fixed FROM (SELECT recording_id, utterance_id, text, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY utterance_id) - 1 AS INTEGER) AS line, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM utterances_v))"""
    )
)
def corrected_transcript(spark, d):
    said = view(spark, d, "utterances_v")
    answers = prompts.numbered_lines(said).select("recording_id", F.expr(_ANSWER).alias("answer"))
    return prompts.corrected(said, answers).select("utterance_id", "line", "text", "edited")


@query()
def condensed_transcripts(spark, d):
    named = library.with_names(view(spark, d, "utterances_v"), view(spark, d, "recording_speakers_v"), view(spark, d, "speakers_v"))
    # a stand-in for the model: the first sixty characters of each part
    short = prompts.condense(prompts.transcript(named), lambda parts: [p[:60] for p in parts], 2000, shared_folder(spark, "condensed"), "first sixty")
    return short.select("recording_id", F.length("transcript").alias("chars"), "transcript")


@query(oracle(r"SELECT utterance_id, len(regexp_extract_all(text, '(?i)ing')) AS n_hits, regexp_replace(text, '(ing)', '<\1>', 'gi') AS marked FROM utterances_v"))
def highlight_split(spark, d):
    parts = X.marked_parts(F.col("text"), F.lit(" ING "))
    shown = F.transform(parts, lambda p: F.when(p["hit"], F.concat(F.lit("<"), p["text"], F.lit(">"))).otherwise(p["text"]))
    return view(spark, d, "utterances_v").select("utterance_id", F.size(F.filter(parts, lambda p: p["hit"])).cast("long").alias("n_hits"), F.array_join(shown, "").alias("marked"))


_VERSION = "concat(o_orderkey % 3, '.', o_orderkey % 12, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.0' WHEN 2 THEN '.5' ELSE '.1-beta' END)"


@query(oracle(f"SELECT o_orderkey AS id, list_transform([string_split({_VERSION}, '.')[1], string_split({_VERSION}, '.')[2], coalesce(string_split({_VERSION}, '.')[3], '0')], lambda x: CAST(regexp_extract(x, '^[0-9]+') AS INTEGER)) >= [1, 9, 1] AS ok FROM orders"))
def version_gate(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.version_at_least(F.expr(_VERSION), F.lit("1.9.1")).alias("ok"))
