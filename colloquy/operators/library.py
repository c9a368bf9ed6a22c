"""The library of recordings: lists, tags, transcripts with names, usage, progress, talk time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, speaker_label, trimmed
from .search import clamped

STAGES = ("transcode", "diarize", "transcribe", "merge", "embed", "summarize")
LIVE_STAGE = "transcribe_segment"


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; raises ``LookupError`` if there is none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"no {key} {value}")
    return found


def page(recordings: DataFrame, limit: int | None = None, offset: int = 0, tag: str | None = None) -> DataFrame:
    """Newest first; a blank tag does not filter."""
    tag = (tag or "").strip()
    rows = recordings.where(F.array_contains("tags", tag)) if tag else recordings
    return rows.orderBy(F.desc("created_at"), "recording_id").offset(max(offset, 0)).limit(clamped(limit, 50, 500))


def distinct_tags(recordings: DataFrame) -> DataFrame:
    return recordings.where(F.size("tags") > 0).select(F.explode("tags").alias("tag")).distinct()


def normalised_tags(tags: Column) -> Column:
    """Trimmed, lower case, no blank ones, each once where it came first."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(trimmed(t))), lambda t: t != ""))


def with_names(utterances: DataFrame, recording_speakers: DataFrame, speakers: DataFrame, nobody: str = "Unknown") -> DataFrame:
    """Utterances with ``speaker_name``: the enrolled name, else ``Speaker N``; null without an index."""
    named = recording_speakers.join(speakers.select("speaker_id", "display_name"), "speaker_id", "left").select("recording_id", "local_idx", "display_name")
    rows = utterances.join(named, ["recording_id", "local_idx"], "left")
    name = F.coalesce("display_name", F.concat(F.lit("Speaker "), F.col("local_idx").cast("string")))
    return rows.withColumn("speaker_name", name).withColumn("label", speaker_label(name, F.col("local_idx"), nobody)).drop("display_name")


def speaker_usage(speakers: DataFrame, recording_speakers: DataFrame) -> DataFrame:
    """Speakers with ``n_recordings``; 0 for those not used."""
    used = recording_speakers.where("speaker_id IS NOT NULL").groupBy("speaker_id").agg(F.countDistinct("recording_id").alias("n_recordings"))
    return speakers.join(used, "speaker_id", "left").withColumn("n_recordings", F.coalesce("n_recordings", F.lit(0)))


def pipeline_progress(jobs: DataFrame) -> DataFrame:
    """One row per recording and stage: the latest job's state, ``pending`` if there is none."""
    stages = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(kind).alias("kind")) for i, kind in enumerate(STAGES)]))
    latest = jobs.where(F.col("kind").isin(*STAGES)).groupBy("recording_id", "kind").agg(F.max_by(F.struct("state", "attempts", "locked_at"), "job_id").alias("job"))
    grid = jobs.select("recording_id").distinct().withColumn("stage", stages).select("recording_id", "stage.*")
    rows = grid.join(latest, ["recording_id", "kind"], "left")
    return rows.select("recording_id", "stage_no", "kind", F.coalesce("job.state", F.lit("pending")).alias("state"), F.coalesce("job.attempts", F.lit(0)).alias("attempts"), F.col("job.locked_at").alias("started_at"))


def progress_summary(progress: DataFrame) -> DataFrame:
    """Per recording: stages done, stages in all, the first one running."""
    return progress.groupBy("recording_id").agg(
        F.count_if(F.col("state") == "done").alias("completed"), F.count("*").alias("total"), F.min_by("kind", F.when(F.col("state") == "running", F.col("stage_no"))).alias("_first"), F.count_if(F.col("state") == "running").alias("_n")
    ).select("recording_id", "completed", "total", F.when(F.col("_n") > 0, F.col("_first")).alias("current"))


def talk_time(utterances: DataFrame) -> DataFrame:
    """``recording_id, label, ms, percent`` of recordings with two speakers or more."""
    spoken = utterances.withColumn("d", F.col("end_ms") - F.col("start_ms")).where("d > 0").groupBy("recording_id", "label").agg(F.sum("d").alias("ms"))
    own = W.partitionBy("recording_id")
    rows = spoken.withColumns({"total": F.sum("ms").over(own), "n": F.count("*").over(own)}).where("n >= 2")
    return rows.select("recording_id", "label", "ms", F.floor(100 * F.col("ms") / F.col("total") + 0.5).cast("long").alias("percent"))


def transcribed_until(segments: DataFrame) -> DataFrame:
    """``recording_id, until_ms``: the latest end of a transcribed segment, null without any."""
    end = F.when(F.col("transcribed_at").isNotNull(), F.coalesce("start_ms", F.lit(0)) + F.coalesce("duration_ms", F.lit(0)))
    return segments.groupBy("recording_id").agg(F.max(end).alias("until_ms"))


def chosen_summary(summaries: DataFrame) -> DataFrame:
    """Per recording the ``general`` summary, else the earliest; ties by template and title."""
    order = F.struct((F.coalesce("template", F.lit("general")) != "general").alias("other"), "created_at", "template", "title")
    return summaries.groupBy("recording_id").agg(F.min_by(F.struct("template", "title", "summary"), order).alias("s")).select("recording_id", "s.*")


def children(table: DataFrame, recording_id, order: list[str]) -> DataFrame:
    """What belongs to one recording, in order."""
    return table.where(F.col("recording_id") == recording_id).orderBy(*order)


def details(recordings: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Recordings with the number of rows that each of ``tables`` has for them, ``n_<name>``."""
    out = recordings
    for name, table in tables.items():
        counts = table.groupBy("recording_id").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counts, "recording_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


# Identifiers of summary templates, the default one first.
TEMPLATES = ("general", "standup", "interview", "one_on_one", "lecture", "sales")


def known_template(name: Column) -> Column:
    """Whether a name is that of a template, but for ASCII case and white space around it."""
    return F.coalesce(ascii_lower(trimmed(name)).isin(*TEMPLATES), F.lit(False))


def canonical_template(name: Column) -> Column:
    """The template that a name stands for; the general one for all that are not known."""
    return F.when(known_template(name), ascii_lower(trimmed(name))).otherwise(TEMPLATES[0])


def summary_templates(spark) -> DataFrame:
    """The six kinds of summary."""
    return spark.createDataFrame([(name, name == TEMPLATES[0]) for name in TEMPLATES], "template string, is_default boolean")
