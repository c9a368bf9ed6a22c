"""Schemas of the conversation tables; readers state them and infer nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "struct<w:string,start_ms:bigint,end_ms:bigint,conf:float,local_idx:int>"
SCHEMAS: dict[str, str] = {
    "recordings": "recording_id string, title string, title_auto boolean, created_at timestamp, device_id string, duration_ms bigint, status string, participants_expected int, audio_format string, sample_rate int, storage_key string, tags array<string>, marks array<int>",
    "segments": "recording_id string, seq int, storage_key string, start_ms bigint, duration_ms bigint, bytes bigint, sha256 binary, uploaded_at timestamp, transcribed_at timestamp",
    "jobs": "job_id bigint, recording_id string, kind string, state string, priority int, attempts int, run_after timestamp, locked_by string, locked_at timestamp, payload string, error string, created_at timestamp, updated_at timestamp",
    "speakers": "speaker_id string, display_name string, embedding array<float>, created_at timestamp",
    "recording_speakers": "recording_id string, local_idx int, speaker_id string, embedding array<float>",
    "utterances": f"utterance_id bigint, recording_id string, local_idx int, start_ms bigint, end_ms bigint, text string, words array<{WORD}>",
    "chunks": "chunk_id bigint, recording_id string, start_ms bigint, end_ms bigint, local_idx int, text string, embedding array<float>",
    "summaries": "recording_id string, title string, summary string, action_items array<string>, topics array<string>, decisions array<string>, model string, template string, created_at timestamp",
    "artifacts": "recording_id string, kind string, data string, created_at timestamp",
    "settings": "key string, value string, updated_at timestamp",
}
# The words that enumerated columns may hold.
STATUSES = ("uploading", "processing", "ready", "failed")
STATES = ("queued", "running", "done", "failed")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read(spark: SparkSession, path: str, name: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema(name)).format(kind).load(path)


def checked(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows as they are; a value that is not allowed is an error, as in the store."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return rows.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {column} "), F.col(column)))).otherwise(F.col(column)))


def put_document(table: DataFrame, keys: list[str], rows: DataFrame, column: str, stamp: str, now: Column) -> DataFrame:
    """Store structs or arrays of ``rows`` as JSON under their keys, replacing what is there."""
    fresh = rows.select(*keys, F.to_json(column).alias(column), now.alias(stamp))
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def required_document(wanted: DataFrame, table: DataFrame, keys: list[str], column: str, kind: str) -> DataFrame:
    """``keys, column`` of the wanted keys, parsed as ``kind``; one that is not stored is an error."""
    rows = wanted.select(*keys).join(table.select(*keys, column), keys, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {column} for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return rows.select(*keys, F.when(F.col(column).isNull(), missing).otherwise(F.from_json(column, kind)).alias(column))


def documents(table: DataFrame, column: str, kind: str, default: str | None = None) -> DataFrame:
    """``table`` with the JSON column parsed as ``kind``; what cannot be read is ``default`` (JSON) or null."""
    parsed = F.from_json(column, kind, {"mode": "PERMISSIVE"})
    if default is not None:
        readable = F.try_parse_json(column).isNotNull()
        parsed = F.when(readable, parsed).otherwise(F.from_json(F.lit(default), kind))
    return table.withColumn(column, parsed)
