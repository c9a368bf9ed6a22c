"""Joins in time: largest overlap, nearest, as-of and marks.

All of them keep an equality on the recording, and the overlap join one on a time
bucket as well, so none becomes a nested loop.  Lookups along time are a union
and one window instead of a join, so they make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the time buckets that the overlap join adds to its key.
BUCKET_MS = 30_000
LINGER_MS = 120


def _buckets(start: Column, end: Column, width: int) -> Column:
    low = F.floor(start / width)
    return F.explode(F.sequence(low, F.greatest(low, F.floor(end / width))))


def max_overlap(words: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``words`` with ``local_idx, overlap_ms`` of the turn that overlaps most; null if none does.

    words: recording_id, word_ord, start_ms, end_ms; turns: recording_id,
    turn_ord, local_idx, start_ms, end_ms.  Of equal overlaps the first turn wins.
    """
    w = words.select("recording_id", "word_ord", "start_ms", "end_ms").withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms"), bucket_ms))
    t = turns.select("recording_id", "turn_ord", "local_idx", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1")).withColumn("bucket", _buckets(F.col("t0"), F.col("t1"), bucket_ms))
    shared = F.least("end_ms", "t1") - F.greatest("start_ms", "t0")
    pairs = w.join(t, ["recording_id", "bucket"]).where(shared > 0)
    best = pairs.groupBy("recording_id", "word_ord").agg(F.max(F.struct(shared.alias("overlap_ms"), (-F.col("turn_ord")).alias("o"), "local_idx")).alias("best"))
    return words.join(best, ["recording_id", "word_ord"], "left").withColumns({"local_idx": F.col("best.local_idx"), "overlap_ms": F.col("best.overlap_ms")}).drop("best")


def nearest_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``recording_id, word_ord, local_idx``: the turn whose midpoint is nearest; the first of equals.

    Words of recordings without turns get null.  Of turns with one midpoint the
    first stands for all, so a word looks at one turn before and one after it.
    """
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    t = turns.select("recording_id", mid.alias("mid"), "turn_ord", "local_idx").groupBy("recording_id", "mid").agg(F.min(F.struct("turn_ord", "local_idx")).alias("turn"))
    w = words.select("recording_id", mid.alias("mid"), "word_ord")
    rows = t.select("recording_id", "mid", F.struct("mid", "turn").alias("at"), F.lit(None).cast("long").alias("word_ord"), F.lit(0).alias("is_word")).unionByName(
        w.select("recording_id", "mid", F.lit(None).cast(t.select(F.struct("mid", "turn").alias("at")).schema["at"].dataType).alias("at"), F.col("word_ord").cast("long").alias("word_ord"), F.lit(1).alias("is_word"))
    )
    order = W.partitionBy("recording_id").orderBy("mid", "is_word")
    rows = rows.withColumn("before", F.last("at", True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.first("at", True).over(order.rowsBetween(0, W.unboundedFollowing))).where("is_word = 1")

    def choice(x: str) -> Column:
        return F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.mid") - F.col("mid")).alias("d"), F.col(f"{x}.turn.turn_ord").alias("o"), F.col(f"{x}.turn.local_idx").alias("local_idx")))

    return rows.select("recording_id", "word_ord", F.least(choice("before"), choice("after"))["local_idx"].alias("local_idx"))


def assign_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``words`` with ``local_idx``: largest overlap, else the nearest turn, else null."""
    found = max_overlap(words, turns)
    missed = nearest_turn(found.where("overlap_ms IS NULL"), turns).withColumnRenamed("local_idx", "near_idx")
    return found.join(missed, ["recording_id", "word_ord"], "left").withColumn("local_idx", F.coalesce("local_idx", "near_idx")).drop("near_idx", "overlap_ms")


def as_of(probes: DataFrame, items: DataFrame, at: str, starts: str, order: list[str], carry: list[str], keys: list[str]) -> DataFrame:
    """``probes`` with ``found``: a struct of ``carry`` of the last item that starts at or before ``at``; null if none.

    Of items that start together the last in ``order`` is found.
    """
    item = F.struct(*carry)
    kind = items.select(item.alias("x")).schema["x"].dataType
    own = [c for c in probes.columns if c not in keys]
    probe = F.struct(*own)
    rows = items.select(*keys, F.col(starts).cast("long").alias("_t"), item.alias("_item"), F.lit(None).cast(probes.select(probe.alias("x")).schema["x"].dataType).alias("_probe"), F.struct(*order).alias("_o"))
    rows = rows.unionByName(probes.select(*keys, F.col(at).cast("long").alias("_t"), F.lit(None).cast(kind).alias("_item"), probe.alias("_probe"), F.lit(None).cast(rows.schema["_o"].dataType).alias("_o")))
    along = W.partitionBy(*keys).orderBy("_t", F.col("_probe").isNotNull(), "_o").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("found", F.last("_item", True).over(along)).where("_probe IS NOT NULL").select(*keys, "_probe.*", "found")


def spoken_word(probes: DataFrame, words: DataFrame, linger_ms: int = LINGER_MS) -> DataFrame:
    """``recording_id, mark_ms, word_ord``: the word being spoken; -1 between words."""
    found = as_of(probes, words, "mark_ms", "start_ms", ["word_ord"], ["word_ord", "end_ms"], ["recording_id"])
    active = F.col("mark_ms") < F.col("found.end_ms") + linger_ms
    return found.select("recording_id", "mark_ms", F.when(active, F.col("found.word_ord")).otherwise(-1).cast("long").alias("word_ord"))


def anchor_marks(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """``recording_id, mark_ms, turn_ord``: the line a mark belongs to.

    That is the last line begun, or the first if none has; a mark after its end
    goes to the next line if that is nearer.  Recordings without lines have none.
    """
    along = W.partitionBy("recording_id").orderBy("start_ms", "turn_ord")
    lines = lines.select("recording_id", "turn_ord", "start_ms", "end_ms", F.lead(F.struct("start_ms", "turn_ord")).over(along).alias("next"))
    found = as_of(marks, lines, "mark_ms", "start_ms", ["turn_ord"], ["turn_ord", "end_ms", "next"], ["recording_id"])
    first = lines.groupBy("recording_id").agg(F.min(F.struct("start_ms", "turn_ord")).alias("first"))
    t = F.col("mark_ms")
    later = (t > F.col("found.end_ms")) & F.col("found.next").isNotNull() & (F.col("found.next.start_ms") - t < t - F.col("found.end_ms"))
    chosen = F.when(F.col("found").isNull(), F.col("first.turn_ord")).when(later, F.col("found.next.turn_ord")).otherwise(F.col("found.turn_ord"))
    return found.join(first, "recording_id").select("recording_id", "mark_ms", chosen.alias("turn_ord"))
