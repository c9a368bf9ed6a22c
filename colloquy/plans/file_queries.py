"""Queries that write files and read them again: exports in all styles, audio laid end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.audio import ingested
from ..sources.file_sink import write_files, written_files
from ..sources.wav_source import WavFrames, concatenated
from .fixtures import oracle, table
from .folders import shared_folder
from .queries import EXPORTS, exported, query


@query(oracle("SELECT concat(recording_id, '/', filename) AS name, strlen(content) AS bytes, sha256(content) AS sha256 FROM (SELECT * FROM markdown UNION ALL SELECT * FROM plain UNION ALL SELECT * FROM srt)", **EXPORTS))
def export_files(spark, d):
    """One file for each recording and style; length and digest as they were taken while writing."""
    folder = shared_folder(spark, "exports")
    rows = exported(spark, d, "markdown").unionByName(exported(spark, d, "text")).unionByName(exported(spark, d, "srt"))
    write_files(rows.select(F.concat_ws("/", "recording_id", "filename").alias("name"), "content"), folder)
    return written_files(spark, folder)


@query(
    oracle(
        """SELECT r AS recording_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(n) * 1000 // 8000 AS BIGINT) AS duration_ms, sum(place * v)::DOUBLE / 128 AS weighed FROM
             (SELECT r, n, v, n * first + n * (n - 1) // 2 AS place FROM (SELECT r, n, v, coalesce(sum(n) OVER (PARTITION BY r ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
              FROM (SELECT event_id // 200 AS r, event_id % 200 AS seq, event_id % 90 AS n, event_id % 26 - 31 AS v FROM events))) GROUP BY r"""
    )
)
def concatenated_audio(spark, d):
    """Segments of eight bits, one letter each, laid end to end; what is read back is weighed by its place."""
    le = lambda c, n: F.unhex(F.concat(*[F.lpad(F.hex(F.expr(f"CAST({c} AS BIGINT) >> {8 * i} & 255")), 2, "0") for i in range(n)]))
    text = lambda s: F.lit(s).cast("binary")
    n = "event_id % 90"
    data = F.expr(f"CAST(repeat(chr(97 + event_id % 26), CAST({n} AS INT)) AS BINARY)")
    content = F.concat(text("RIFF"), le("0", 4), text("WAVEfmt "), le("16", 4), le("1", 2), le("1", 2), le("8000", 4), le("8000", 4), le("1", 2), le("8", 2), text("data"), le(n, 4), data)
    segments = table(spark, d, "events").select(F.floor(F.col("event_id") / 200).alias("recording_id"), (F.col("event_id") % 200).cast("int").alias("seq"), content.alias("content"))
    folder = shared_folder(spark, "audio")
    made = concatenated(segments, folder)
    spark.dataSource.register(WavFrames)
    frames = spark.read.format("wav").option("frames", 3000).load(folder).select(F.regexp_extract("path", "([0-9]+)/audio.wav$", 1).cast("long").alias("recording_id"), "first_frame", "samples")
    each = frames.select("recording_id", "first_frame", F.posexplode("samples").alias("i", "x"))
    read = each.groupBy("recording_id").agg(F.count("*").alias("n_samples"), F.sum((F.col("first_frame") + F.col("i")) * F.col("x").cast("double")).alias("weighed"))
    return made.select("recording_id", "n_segments", "duration_ms").join(read, "recording_id")


@query(
    oracle(
        """SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS recording_id, page_id, ext AS audio_format, 'processing' AS status, 'transcode' AS kind,
                  concat(concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)), '/segments/000001.', ext) AS name, strlen(html) AS bytes, sha256(html) AS sha256
           FROM (SELECT page_id, html, sha256(concat('/in/', page_id, CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.b.MP3' ELSE '' END, chr(0), html)) AS h, CASE page_id % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'MP3' ELSE 'bin' END AS ext FROM pages)"""
    )
)
def ingested_files(spark, d):
    """Whole files taken in: the new recordings with their jobs, and the copies as they were written."""
    path = F.expr("concat('/in/', page_id, CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.b.MP3' ELSE '' END)")
    files = table(spark, d, "pages").select(path.alias("path"), F.col("html").cast("binary").alias("content"), F.col("page_id").cast("int").alias("page_id"))
    folder = shared_folder(spark, "blobs")
    recordings, segments, jobs = ingested(files, folder, F.lit("2024-01-15").cast("timestamp"), participants=F.col("page_id"))
    added = recordings.join(segments.select("recording_id", F.col("storage_key").alias("name"), "bytes"), "recording_id").join(jobs.select("recording_id", "kind"), "recording_id")
    written = written_files(spark, folder).select("name", F.col("bytes").alias("n_written"), "sha256")
    return added.join(written, "name").where("bytes = n_written").select("recording_id", F.col("participants_expected").cast("long").alias("page_id"), "audio_format", "status", "kind", "name", "bytes", "sha256")
