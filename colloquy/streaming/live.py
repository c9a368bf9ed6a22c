"""Streams of arriving segments and of worker leases.

A provisional transcript grows by micro-batch while a recording is uploading; a
later full pass replaces it (see ``rows.replace_rows``).  What decides whether a
segment still counts is the recording's status, not a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.rows import latest
from ..operators.windows import running_offsets
from ..sources.files import names_in, write_text

WORDS = "recording_id bigint, seq int, ord int, w string, start_ms bigint, end_ms bigint"
SEGMENT_COLUMNS = "recording_id bigint, seq int, duration_ms bigint, words array<struct<w:string,start_ms:bigint,end_ms:bigint>>"


def timeline(segments: DataFrame) -> DataFrame:
    """Words of arriving segments on their recording's own clock, in order of arrival and ``seq``.

    The state of a recording is the end of what was laid down so far and the
    numbers of the segments in it; a segment that comes again is left out.
    """

    def lay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, seen = state.get if state.exists else (0, [])
        seen = set(seen)
        # a recording's segments of one micro-batch
        batch = pd.concat(list(frames), ignore_index=True).sort_values("seq")
        out = []
        for seq, duration, words in zip(batch["seq"], batch["duration_ms"], batch["words"], strict=True):
            if int(seq) in seen:
                continue
            seen.add(int(seq))
            for i, w in enumerate(words if words is not None else []):
                out.append((key[0], int(seq), i, w["w"], int(w["start_ms"]) + offset, int(w["end_ms"]) + offset))
            offset += int(duration)
        state.update((offset, sorted(seen)))
        yield pd.DataFrame(out, columns=["recording_id", "seq", "ord", "w", "start_ms", "end_ms"])

    return segments.groupBy("recording_id").applyInPandasWithState(lay, WORDS, "offset bigint, seen array<int>", "append", GroupStateTimeout.NoTimeout)


def live_drain(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """:func:`timeline` of the segments whose recording is still uploading."""
    open_ = recordings.where("status = 'uploading'").select("recording_id")
    return timeline(segments.join(open_, "recording_id", "left_semi"))


def transcript_flips(segments: DataFrame, statuses: DataFrame) -> DataFrame:
    """Provisional words of two streams: :data:`WORDS`, of segments that came while their recording was uploading.

    ``segments`` has :data:`SEGMENT_COLUMNS` and ``at``, ``statuses`` recording_id,
    status and ``at``.  A recording uploads until its first status that is another
    one; a segment that is later than that, or as late, is left to the full pass.
    Words are laid down as in :func:`timeline`, in order of ``at`` and ``seq``.

    Rows of a micro-batch are taken in order of ``at``, so wherever two streams that
    are in that order are cut, the result is the same.  The state of a recording is
    its status, the end of what was laid down, and the numbers of its segments.
    """
    none = lambda kind: F.lit(None).cast(kind)
    words = segments.schema["words"].dataType
    both = segments.select("recording_id", "at", "seq", "duration_ms", "words", none("string").alias("status")).unionByName(
        statuses.select("recording_id", "at", none("int").alias("seq"), none("bigint").alias("duration_ms"), F.lit(None).cast(words).alias("words"), "status")
    )

    def lay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, seen, open_ = state.get if state.exists else (0, [], True)
        seen, out = set(seen), []
        rows = pd.concat(list(frames), ignore_index=True)
        # a status comes before the segments of its time
        rows = rows.assign(_kind=rows["status"].isna()).sort_values(["at", "_kind", "seq"], kind="stable")
        for status, seq, duration, said in zip(rows["status"], rows["seq"], rows["duration_ms"], rows["words"], strict=True):
            if not open_:
                break
            if not pd.isna(status):
                open_ = status == "uploading"
            elif int(seq) not in seen:
                seen.add(int(seq))
                for i, w in enumerate(said if said is not None else []):
                    out.append((key[0], int(seq), i, w["w"], int(w["start_ms"]) + offset, int(w["end_ms"]) + offset))
                offset += int(duration)
        state.update((offset, sorted(seen), open_))
        yield pd.DataFrame(out, columns=["recording_id", "seq", "ord", "w", "start_ms", "end_ms"])

    return both.groupBy("recording_id").applyInPandasWithState(lay, WORDS, "offset bigint, seen array<int>, open boolean", "append", GroupStateTimeout.NoTimeout)


def full_pass(segments: DataFrame) -> DataFrame:
    """:data:`WORDS` of whole recordings: every segment once, the latest of those with one ``seq``, laid end to end by ``seq``."""
    once = latest(segments, ["recording_id", "seq"], ["at"])
    placed = running_offsets(once, ["recording_id"], ["seq"], "duration_ms")
    said = placed.select("recording_id", "seq", "offset_ms", F.posexplode("words").alias("ord", "x"))
    return said.select("recording_id", "seq", "ord", "x.w", (F.col("x.start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("x.end_ms") + F.col("offset_ms")).alias("end_ms"))


#: Folders of a table that is kept by upserts.
BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_buckets(batch: DataFrame, table: str, keys: list[str], order: list[str], buckets: int = BUCKETS, number: int | None = None) -> list[int]:
    """Merge rows into ``table`` (a path) so that each key has its latest row; only the buckets of their keys are read and written.

    Returns those buckets.  A bucket is written beside the table and then takes the
    place of the old one, so a merge that fails leaves each bucket old or new; run
    again it changes nothing that is done already, as the latest row stays the
    latest.  With ``number`` a batch that was merged as a whole is not merged again.
    """
    spark = batch.sparkSession
    if number is not None and f"{number}" in names_in(spark, f"{table}-done"):
        return []
    batch = latest(batch, keys, order).withColumn("bucket", bucket_of(keys, buckets))
    # as many numbers as the table has buckets
    touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())
    present = [b for b in touched if f"bucket={b}" in names_in(spark, table)]
    rows = batch
    if present:
        old = spark.read.schema(batch.schema).option("basePath", table).parquet(*[f"{table}/bucket={b}" for b in present])
        rows = latest(old.unionByName(batch), [*keys, "bucket"], order)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    if number is not None:
        write_text(spark, f"{table}-done/{number}", "")
    return touched


def upsert_stream(segments: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Keep ``table`` (a path, with a column ``bucket`` more) at the latest row of each key; a micro-batch rewrites the buckets that it touches."""

    def publish(batch: DataFrame, number: int) -> None:
        merge_buckets(batch, table, keys, order, buckets, number)

    return segments.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files until all that is there has been read."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeaseWatch(StatefulProcessor):
    """Leases of jobs: the holder and its last beat, and one timer for when that is too long ago."""

    def __init__(self, lease_s: float, on_clock: bool):
        self.lease_s, self.on_clock = lease_s, on_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "worker string, at double")

    def _watch(self, timers: TimerValues, at: float) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        began = timers.getCurrentProcessingTimeInMs() if self.on_clock else int(at * 1000)
        # lost when the lease is over, not at its end
        self.handle.registerTimer(began + int(self.lease_s * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[Row]:
        worker, at = self.lease.get() if self.lease.exists() else (None, None)
        for beat in sorted(rows, key=lambda r: (r["at"], r["worker"])):
            when = beat["at"].timestamp()
            if worker is not None and when < at:
                continue
            if worker is None:
                yield Row(job_id=key[0], worker=beat["worker"], state="held")
            elif when - at > self.lease_s:
                yield Row(job_id=key[0], worker=worker, state="lost")
                yield Row(job_id=key[0], worker=beat["worker"], state="held")
            elif beat["worker"] != worker:
                yield Row(job_id=key[0], worker=beat["worker"], state="moved")
            worker, at = beat["worker"], when
        if worker is not None:
            self.lease.update((worker, at))
            self._watch(timerValues, at)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        worker, _ = self.lease.get()
        self.lease.clear()
        yield Row(job_id=key[0], worker=worker, state="lost")

    def close(self) -> None:
        pass


def lease_state(beats: DataFrame, lease_s: float, on_clock: bool = False, late: str = "0 seconds") -> DataFrame:
    """``job_id, worker, state``: leases from heartbeats (job_id, worker, at), a row whenever one changes.

    ``held`` at a first heartbeat, ``moved`` when another worker beats, and ``lost``
    when ``lease_s`` go by without a beat, which a timer tells without waiting for
    another one: by the clock, with ``on_clock``, counted from when the last beat
    was taken in; else by the times of all beats, less ``late``.  Beats of a
    micro-batch count in order of their time; one older than the job's last, or than
    what ``late`` allows, changes nothing.

    The session needs the state store :data:`ROCKS`, which keeps timers.
    """
    beats = beats.select("job_id", "worker", "at")
    if not on_clock:
        beats = beats.withWatermark("at", late)
    return beats.groupBy("job_id").transformWithState(LeaseWatch(lease_s, on_clock), "job_id bigint, worker string, state string", "append", "ProcessingTime" if on_clock else "EventTime")


def wake_ups(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream that only tells when to look for work."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").alias("at"))


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a transition for each micro-batch, one writer at a time."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
