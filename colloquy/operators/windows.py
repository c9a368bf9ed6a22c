"""Sequences along time: utterances, merged intervals, retrieval windows, offsets, splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import trimmed, words

GAP_MS = 1500
WINDOW_MS, OVERLAP_MS = 45_000, 5_000


def joined(order: str, text: str, sep: str = " ") -> Column:
    """Texts of a group in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def utterances(words_: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Words grouped into utterances: a new one at another speaker or after a longer gap.

    The gap runs from the end of the word before, not from the latest end so far;
    words without a speaker belong together.  Words: recording_id, word_ord, w,
    start_ms, end_ms, local_idx.
    """
    along = W.partitionBy("recording_id").orderBy("word_ord")
    fresh = F.lag("end_ms").over(along).isNull() | ~F.col("local_idx").eqNullSafe(F.lag("local_idx").over(along)) | (F.col("start_ms") - F.lag("end_ms").over(along) > gap_ms)
    marked = words_.withColumn("_new", fresh.cast("int")).withColumn("utterance_no", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("recording_id", "utterance_no").agg(
        F.first("local_idx").alias("local_idx"), F.min_by("start_ms", "word_ord").alias("start_ms"), F.max("end_ms").alias("end_ms"), joined("word_ord", "w").alias("text"), F.count("*").alias("n_words")
    )


def merged(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching intervals as one, by ``keys``."""
    along = W.partitionBy(*keys).orderBy(start, end)
    upto = F.max(end).over(along.rowsBetween(W.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", (upto.isNull() | (F.col(start) > upto)).cast("int")).withColumn("_no", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_no").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_no")


def chunk_windows(words_: DataFrame, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """Retrieval chunks of utterances: ``recording_id, utterance_no, window_no, start_ms, end_ms, text``.

    An utterance of ``window_ms`` or less is one chunk.  A longer one is cut into
    windows that overlap, the last one ending with it; bounds are drawn in to the
    words inside, and windows without words are left out.  A word names its
    windows itself, so there is no join between words and windows.
    """
    step = window_ms - overlap_ms
    own = W.partitionBy("recording_id", "utterance_no")
    rows = words_.withColumns({"_s": F.min("start_ms").over(own), "_e": F.max("end_ms").over(own)})
    last = F.greatest(F.lit(0), F.ceil((F.col("_e") - F.col("_s") - window_ms) / step))
    low = F.greatest(F.lit(0), F.floor((F.col("start_ms") - F.col("_s") - window_ms) / step) + 1)
    high = F.least(last, F.ceil((F.col("end_ms") - F.col("_s")) / step) - 1)
    short = F.col("_e") - F.col("_s") <= window_ms
    numbers = F.when(short, F.array(F.lit(0).cast("long"))).when((low <= high) & (F.col("start_ms") < F.col("_e")), F.sequence(low, high))
    rows = rows.withColumn("window_no", F.explode(numbers))
    out = rows.groupBy("recording_id", "utterance_no", "window_no").agg(F.min_by("start_ms", "word_ord").alias("start_ms"), F.max("end_ms").alias("end_ms"), joined("word_ord", "w").alias("text"))
    return out.where(trimmed(F.col("text")) != "")


def running_offsets(rows: DataFrame, keys: list[str], order: list, length: str) -> DataFrame:
    """``rows`` with ``offset_ms``: the sum of ``length`` of the rows before."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset_ms", F.coalesce(F.sum(length).over(before), F.lit(0)))


def tumbling(start: Column, end: Column, width: int) -> Column:
    """Array of (start, end): windows of ``width``, the last one cut."""
    n = F.ceil((end - start) / width).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((start + i * width).alias("start"), F.least(start + (i + 1) * width, end).alias("end"))))


def split_evenly(start: Column, end: Column, most: int) -> Column:
    """Array of (start, end): as few adjoining pieces as keep to ``most``, of about one length."""
    length = end - start
    pieces = F.greatest(F.ceil(length / most).cast("long"), F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda i: F.struct((start + F.floor(length * i / pieces)).alias("start"), (start + F.floor(length * (i + 1) / pieces)).alias("end")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; a lambda would compute what it names again for each element."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(ArrayType(LongType()))
def _running(lengths: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else np.cumsum(x) for x in lengths], dtype="object")


def interpolated(text: Column, start: Column, end: Column) -> Column:
    """Array of (pos, token, start_ms, end_ms): the span shared out by token length."""
    tokens = words(text)
    given = F.struct(tokens.alias("tokens"), _running(F.transform(tokens, lambda t: F.length(t).cast("long"))).alias("upto"), F.greatest(end - start, F.lit(0)).cast("double").alias("span"), start.alias("start"))

    def placed(g: Column) -> Column:
        at = lambda upto: (g["start"] + F.floor(g["span"] * upto / F.element_at(g["upto"], -1) + 0.5)).cast("long")
        return F.transform(
            g["tokens"], lambda token, i: F.struct(i.alias("pos"), token.alias("token"), at(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(g["upto"], i - 1))).alias("start_ms"), at(F.get(g["upto"], i)).alias("end_ms"))
        )

    return _bound(given, placed)


def spread_evenly(text: Column, length_ms: Column) -> Column:
    """Array of (w, start_ms, end_ms): equal parts of a clip, the last takes what is left."""

    def spread(g: Column) -> Column:
        n = F.size(g["tokens"])
        part = F.floor(g["length"] / n)
        return F.transform(g["tokens"], lambda w, i: F.struct(w.alias("w"), (i * part).alias("start_ms"), F.when(i == n - 1, g["length"]).otherwise((i + 1) * part).alias("end_ms")))

    return _bound(F.struct(words(text).alias("tokens"), length_ms.alias("length")), spread)


def words_of_tokens(tokens: DataFrame, keys: list[str], order: str, token: str = "token") -> DataFrame:
    """Subword tokens to words: a token with a leading space, or the first, begins one."""
    along = W.partitionBy(*keys).orderBy(order)
    fresh = (F.col(token).startswith(" ") | F.col(token).startswith("▁") | F.lag(token).over(along).isNull()).cast("int")
    marked = tokens.withColumn("_new", fresh).withColumn("word_no", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("_bare", F.regexp_replace(token, "^[ ▁]+", ""))
    return marked.groupBy(*keys, "word_no").agg(joined(order, "_bare", "").alias("w"), F.min_by("start_ms", order).alias("start_ms"), F.max("end_ms").alias("end_ms")).where("w <> ''")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    back = W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")
