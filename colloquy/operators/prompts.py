"""Texts for and from language models: transcripts, parts, context, corrections, exports.

A model is a function from prompts to answers, given by the caller; it runs in
tasks over batches of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import parse_line_edits
from ..functions.text import accepts_edit, clock, minutes_clock, shortened, slug, srt_time, trimmed
from ..sources.files import names_in
from .windows import joined

BUDGET, LEAST_BUDGET, ROUNDS = 18_000, 2_000, 4
LOOKAHEAD = 4
#: Utterances that are aligned at once.
ALIGNED = 200


def transcript(utterances: DataFrame, label: str = "label") -> DataFrame:
    """``recording_id, transcript``: a line ``Label: text`` for each utterance, in order."""
    line = F.concat(F.col(label), F.lit(": "), trimmed(F.col("text")), F.lit("\n"))
    return utterances.withColumn("_line", line).groupBy("recording_id").agg(joined("utterance_id", "_line", "").alias("transcript"))


def lines_within(text: Column, budget: int) -> Column:
    """Array of parts: whole lines until the next would go over ``budget``.

    A line that is longer by itself is a part of its own; a blank rest is dropped.
    """
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, line: Column) -> Column:
        over = (s["now"] != "") & (F.length(s["now"]) + F.length(line) + 1 > budget)
        grown = F.concat(s["now"], line, F.lit("\n"))
        return F.when(over, F.struct(F.concat(line, F.lit("\n")).alias("now"), F.concat(s["done"], F.array(s["now"])).alias("done"))).otherwise(F.struct(grown.alias("now"), s["done"].alias("done")))

    # a last line end makes no line of its own
    lines = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    parts = F.aggregate(lines, start, step, lambda s: F.when(trimmed(s["now"]) != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def answered(rows: DataFrame, prompt: str, answer: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``rows`` with the model's answer to a column of prompts, a batch at a time."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()), dtype="object")

    return rows.withColumn(answer, ask(prompt))


def stored_answers(rows: DataFrame, prompt: str, answer: str, model: Callable[[list[str]], list[str]], model_name: str, store: str) -> DataFrame:
    """:func:`answered`, but a prompt that was ever answered is not asked again.

    Answers lie under ``store``, a folder that all executors share, by a digest of
    the model's name and the prompt, in folders by its first byte.  Prompts that are
    not there are asked once each, however many rows have them, and their answers
    are written before any is used; so a retry, a later round or another run reads
    them, and a model that is not deterministic still gives one answer.  If two
    runs have asked at once, the smaller answer counts for both.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.concat(F.lit(model_name), F.lit("\n"), F.col(prompt)).cast("binary"), 256)
    known_schema = "digest string, answer string, shard string"
    keyed = rows.withColumn("_digest", digest)
    shard = F.left("digest", F.lit(2))
    asked = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.min(prompt).alias("prompt")).withColumn("shard", shard)
    path = f"{store}/answers"

    def known() -> DataFrame:
        if not names_in(spark, path):
            return spark.createDataFrame([], known_schema)
        return spark.read.schema(known_schema).parquet(path)

    new = asked.join(known().select("digest"), "digest", "left_anti")
    if not new.isEmpty():
        told = answered(new, "prompt", "answer", model).select("digest", "answer", "shard")
        told.write.mode("append").partitionBy("shard").parquet(path)
    answers = known().groupBy("digest").agg(F.min("answer").alias(answer)).withColumnRenamed("digest", "_digest")
    return keyed.join(answers, "_digest", "left").drop("_digest")


def condense(transcripts: DataFrame, model: Callable[[list[str]], list[str]], budget: int = BUDGET, store: str | None = None, model_name: str = "") -> DataFrame:
    """Shorten ``transcript`` to ``budget`` characters by notes on its parts, in at most four rounds.

    What is still too long after that is cut.  Rounds end as soon as all fit.  With
    ``store`` (see :func:`stored_answers`) each round is written there and read by
    the next, so no part is asked twice; without it a plan may run the model again
    whenever it is evaluated.
    """
    budget = max(budget, LEAST_BUDGET)
    rows, run = transcripts, uuid.uuid4().hex

    def settled(df: DataFrame, name: str) -> DataFrame:
        if store is None:
            return df
        df.write.parquet(f"{store}/rounds/{run}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{store}/rounds/{run}/{name}")

    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        fits, rest = rows.where(F.length("transcript") <= budget), rows.where(F.length("transcript") > budget)
        if rest.isEmpty():
            break
        done.append(fits)
        parts = settled(rest.select("recording_id", F.posexplode(lines_within(F.col("transcript"), budget * 2 // 3)).alias("part", "body")), f"parts-{turn}")
        notes = answered(parts, "body", "notes", model) if store is None else stored_answers(parts, "body", "notes", model, model_name, store)
        notes = notes.withColumn("notes", trimmed(F.col("notes")))
        rows = settled(notes.groupBy("recording_id").agg(joined("part", "notes", "\n\n").alias("transcript")), f"notes-{turn}")
    for more in done:
        rows = rows.unionByName(more.select(rows.columns))
    return rows.withColumn("transcript", F.left("transcript", F.lit(budget)))


def context(hits: DataFrame) -> DataFrame:
    """One row ``context``: search hits as numbered blocks ``[n] (title, mm:ss)``, best first."""
    ordered = hits.withColumn("n", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.coalesce("title", F.lit("Untitled recording")), F.lit(", "), minutes_clock(F.coalesce("start_ms", F.lit(0))), F.lit(")\n"))
    blocks = ordered.withColumn("block", F.concat(head, trimmed(F.col("text"))))
    return blocks.agg(joined("n", "block", "\n\n").alias("context")).withColumn("context", F.when(F.col("context") == "", "No matching excerpts were found.").otherwise(F.col("context")))


def history(turns: DataFrame, n: int = 12, limit: int = 1200) -> DataFrame:
    """The last ``n`` turns of each conversation, long ones cut: ``conv_id, turn, role, text``."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n)
    return rows.select("conv_id", "turn", "role", shortened(F.col("text"), limit).alias("text"))


def retrieval_query(turns: DataFrame, question: str, n: int = 2) -> DataFrame:
    """``conv_id, query``: the last ``n`` user turns and the question."""
    asked = history(turns.where("role = 'user'"), n, 1 << 30).groupBy("conv_id").agg(joined("turn", "text").alias("before"))
    return asked.select("conv_id", F.concat_ws(" ", "before", F.lit(question)).alias("query"))


def numbered_lines(utterances: DataFrame) -> DataFrame:
    """``recording_id, lines``: trimmed texts after their numbers from 0, blank ones left out, for a model to correct."""
    line = F.row_number().over(W.partitionBy("recording_id").orderBy("utterance_id")) - 1
    rows = utterances.select("recording_id", line.alias("line"), trimmed(F.col("text")).alias("text")).where("text <> ''")
    return rows.withColumn("said", F.concat(F.col("line").cast("string"), F.lit(": "), F.col("text"))).groupBy("recording_id").agg(joined("line", "said", "\n").alias("lines"))


def translation_block(title: Column, summary: Column, action_items: Column, decisions: Column, topics: Column) -> Column:
    """A summary as plain text for translation; blank parts and entries are left out."""

    def listed(head: str, items: Column) -> Column:
        kept = F.filter(F.transform(items, trimmed), lambda x: x != "")
        return F.when(F.size(kept) > 0, F.concat(F.lit(head + "\n- "), F.array_join(kept, "\n- ")))

    kept = F.filter(F.transform(topics, trimmed), lambda x: x != "")
    line = F.when(F.size(kept) > 0, F.concat(F.lit("Topics: "), F.array_join(kept, ", ")))
    return F.concat_ws("\n\n", F.nullif(trimmed(title), F.lit("")), F.nullif(trimmed(summary), F.lit("")), listed("Action items:", action_items), listed("Decisions:", decisions), line)


def correct_names(utterances: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply corrections (recording_id, line, new_text; lines from 0, in order of utterance_id) that are small enough.

    ``edited`` tells whether any was taken.  Several corrections of a line are
    tried in turn, by the column ``nth`` if there is one, each against the text as
    it is by then; a line that is not there is ignored.
    """
    nth = F.col("nth") if "nth" in edits.columns else F.lit(0)
    given = edits.groupBy("recording_id", "line").agg(F.sort_array(F.collect_list(F.struct(nth.alias("nth"), "new_text"))).alias("_edits"))
    line = F.row_number().over(W.partitionBy("recording_id").orderBy("utterance_id")) - 1
    rows = utterances.withColumn("line", line).join(given, ["recording_id", "line"], "left")

    def step(s: Column, edit: Column) -> Column:
        good = F.coalesce(accepts_edit(s["text"], edit["new_text"]), F.lit(False))
        return F.struct(F.when(good, trimmed(edit["new_text"])).otherwise(s["text"]).alias("text"), (s["edited"] | good).alias("edited"))

    done = F.aggregate(F.coalesce("_edits", F.array().cast(rows.schema["_edits"].dataType)), F.struct(F.col("text"), F.lit(False).alias("edited")), step)
    return rows.withColumn("_done", done).withColumns({"text": F.col("_done.text"), "edited": F.col("_done.edited")}).drop("_edits", "_done")


def corrected(utterances: DataFrame, answers: DataFrame) -> DataFrame:
    """:func:`correct_names` by what a model answered (recording_id, answer) to :func:`numbered_lines`."""
    edits = answers.select("recording_id", F.posexplode(parse_line_edits(F.col("answer"))).alias("nth", "e"))
    return correct_names(utterances, edits.select("recording_id", "nth", "e.line", "e.new_text"))


def srt_cues(utterances: DataFrame) -> DataFrame:
    """``recording_id, cue_no, cue``: numbered subtitles; a span of nothing lasts two seconds."""
    no = F.row_number().over(W.partitionBy("recording_id").orderBy("start_ms", "utterance_id"))
    end = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + 2000)
    rows = utterances.withColumn("cue_no", no)
    cue = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(end), F.lit("\n"), F.col("label"), F.lit(": "), trimmed(F.col("text")), F.lit("\n"))
    return rows.select("recording_id", "cue_no", cue.alias("cue"))


def _section(title: str, body: Column) -> Column:
    return F.when(F.length(body) > 0, F.concat(F.lit(title), body))


def exports(utterances: DataFrame, recordings: DataFrame, summaries: DataFrame | None, style: str = "markdown") -> DataFrame:
    """``recording_id, filename, content``: a recording as Markdown, plain text or subtitles.

    Utterances have ``label``; recordings recording_id, title, created_at,
    duration_ms; summaries title, summary, action_items, decisions, topics.
    """
    extension = {"markdown": "md", "text": "txt", "srt": "srt"}[style]
    said = {
        "markdown": F.concat(F.lit("**"), F.col("label"), F.lit("** _("), clock(F.col("start_ms")), F.lit(")_\n"), trimmed(F.col("text")), F.lit("\n")),
        "text": F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), F.col("label"), F.lit(": "), trimmed(F.col("text"))),
    }
    if style == "srt":
        lines = srt_cues(utterances).groupBy("recording_id").agg(joined("cue_no", "cue", "\n").alias("lines"))
    else:
        order = F.struct("start_ms", "utterance_id")
        lines = utterances.withColumn("_o", order).withColumn("_line", said[style]).groupBy("recording_id").agg(joined("_o", "_line", "\n").alias("lines"))
    rows = recordings.join(lines, "recording_id", "left")
    if summaries is not None:
        rows = rows.join(summaries.select("recording_id", F.col("title").alias("s_title"), "summary", "action_items", "decisions", "topics"), "recording_id", "left")
    else:
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"s_title": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "action_items": none, "decisions": none, "topics": none})
    title = F.coalesce("s_title", "title", F.lit("Untitled recording"))
    name = F.concat(slug(title), F.lit(f".{extension}"))
    when = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    length = F.when(F.col("duration_ms") > 0, clock(F.col("duration_ms")))
    if style == "srt":
        return rows.select("recording_id", name.alias("filename"), F.coalesce("lines", F.lit("")).alias("content"))
    item = lambda before: lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(before), x)), "\n")
    if style == "markdown":
        parts = [F.concat(F.lit("# "), title), F.concat(F.lit("_"), F.concat_ws(" · ", when, length), F.lit("_")), _section("## Summary\n\n", F.col("summary")), _section("## Action items\n\n", item("- [ ] ")("action_items"))]
        parts += [_section("## Decisions\n\n", item("- ")("decisions")), _section("## Topics\n\n", F.array_join(F.transform("topics", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), " ")), F.concat(F.lit("## Transcript\n\n"), F.coalesce("lines", F.lit("")))]
    else:
        parts = [F.concat(title, F.lit("\n"), F.concat_ws("  ·  ", when, length)), _section("SUMMARY\n", F.col("summary")), _section("ACTION ITEMS\n", item("  - ")("action_items")), _section("DECISIONS\n", item("  - ")("decisions"))]
        parts += [F.concat(F.lit("TRANSCRIPT\n\n"), F.coalesce("lines", F.lit("")))]
    return rows.select("recording_id", name.alias("filename"), F.concat(trimmed(F.concat_ws("\n\n", *parts)), F.lit("\n")).alias("content"))


def outline(title: Column, branches: Column) -> Column:
    """A mind map as Markdown: a heading and a branch per (name, items), empty ones left out."""
    full = F.filter(branches, lambda b: F.size(b["items"]) > 0)
    drawn = F.transform(full, lambda b: F.concat(F.lit("## "), b["name"], F.lit("\n"), F.array_join(F.transform(b["items"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(F.array_join(drawn, "\n\n"), F.lit("")))


def align_tokens(tokens: list[str], words: list[dict], start: int, end: int) -> list[tuple[str, int, int]]:
    """Times of display tokens from timed words of one utterance.

    A token takes the time of the next word of the same key among four; tokens
    between share the time between their neighbours by length.
    """
    import re

    def key(x: str) -> str:
        return re.sub("[^a-z0-9']", "", x.lower()) or x.lower()

    def share(part: list[str], a: int, b: int) -> list[tuple[str, int, int]]:
        total, done, out = sum(map(len, part)) or 1, 0, []
        for x in part:
            first = a + int(max(0, b - a) * done / total + 0.5)
            done += len(x)
            out.append((x, first, a + int(max(0, b - a) * done / total + 0.5)))
        return out

    timed = [w for w in words or [] if w["end_ms"] > w["start_ms"]]
    if not tokens or (not timed and end <= start):
        return []
    if not timed:
        return share(tokens, start, end)
    anchors: list[dict | None] = [None] * len(tokens)
    at = 0
    for i, token in enumerate(tokens):
        k = next((k for k in range(at, min(len(timed), at + LOOKAHEAD)) if key(timed[k]["w"]) == key(token)), None)
        if k is not None:
            anchors[i], at = timed[k], k + 1
    out: list[tuple[str, int, int]] = []
    begin = min(start, timed[0]["start_ms"])
    while len(out) < len(tokens):
        i = len(out)
        if anchors[i]:
            out.append((tokens[i], anchors[i]["start_ms"], anchors[i]["end_ms"]))
            begin = anchors[i]["end_ms"]
            continue
        j = next((j for j in range(i, len(tokens)) if anchors[j]), len(tokens))
        after = anchors[j]["start_ms"] if j < len(tokens) else max(begin, end)
        out += share(tokens[i:j], begin, max(begin, after))
        begin = after
    return out


_TIMED = pa.list_(pa.struct([("token", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and words of a few utterances are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ALIGNED):
            part = batch.slice(at, ALIGNED)
            tokens = [[{"token": t, "start_ms": a, "end_ms": b} for t, a, b in align_tokens((x or "").split(), w or [], s, e)] for x, w, s, e in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, _TIMED)], ["utterance_id", "tokens"])


def timed_tokens(utterances: DataFrame) -> DataFrame:
    """``utterance_id, tokens``: display tokens with times; utterances have ``words`` (w, start_ms, end_ms)."""

    own = utterances.select("utterance_id", "text", "words", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    return own.mapInArrow(_aligned, f"utterance_id {own.schema['utterance_id'].dataType.simpleString()}, tokens array<struct<token:string,start_ms:bigint,end_ms:bigint>>")
