"""Audio files: WAV headers and samples, byte ranges, types, segment uploads."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .file_sink import write_files

# File extensions by media type, and media types by extension.
EXTENSIONS = {
    "audio/mp4": "m4a", "audio/m4a": "m4a", "audio/x-m4a": "m4a", "audio/aac": "m4a", "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/wav": "wav", "audio/x-wav": "wav", "audio/wave": "wav",
    "audio/ogg": "ogg", "audio/opus": "ogg", "audio/webm": "webm", "audio/flac": "flac", "audio/x-flac": "flac",
}
MEDIA_TYPES = {"m4a": "audio/mp4", "mp4": "audio/mp4", "aac": "audio/mp4", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "opus": "audio/ogg", "webm": "audio/webm", "flac": "audio/flac"}


@dataclass(frozen=True)
class WavLayout:
    """Where the frames of a WAV file lie and how they are to be read."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return max(self.channels, 1) * (self.bits // 8)

    def mono(self, body: bytes) -> np.ndarray:
        """Samples in -1..1 of whole frames, channels averaged."""
        if self.kind == 3 and self.bits == 32:
            samples = np.frombuffer(body, "<f4").astype(float)
        elif self.bits == 8:
            samples = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
        elif self.bits == 24:
            raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            samples = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / (1 << 23)
        else:
            samples = np.frombuffer(body, f"<i{self.bits // 8}").astype(float) / (1 << (self.bits - 1))
        return samples.reshape(-1, max(self.channels, 1)).mean(axis=1) if len(samples) else np.zeros(0)


def read_layout(file: BinaryIO) -> WavLayout:
    """The layout of PCM with 8, 16, 24 or 32 bits, or 32-bit floats; only the heads of chunks are read."""
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout, body = 12, None, None
    size_of_file = file.seek(0, 2)
    while at + 8 <= size_of_file:
        file.seek(at)
        name, size = file.read(4), int.from_bytes(file.read(4), "little")
        if name == b"fmt ":
            chunk = file.read(min(size, 26))
            layout = tuple(int.from_bytes(chunk[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            if layout[0] == 0xFFFE and len(chunk) >= 26:
                layout = (int.from_bytes(chunk[24:26], "little"), *layout[1:])
        elif name == b"data":
            body = at + 8, min(size, size_of_file - at - 8)
        at += 8 + size + size % 2
    if layout is None or body is None:
        raise ValueError("a WAV file needs fmt and data chunks")
    kind, channels, rate, bits = layout
    if (kind, bits) not in {(3, 32), (1, 8), (1, 16), (1, 24), (1, 32)}:
        raise ValueError(f"unsupported WAV layout {kind}/{bits}")
    return WavLayout(kind, channels, rate, bits, body[0], body[1] // (max(channels, 1) * (bits // 8)))


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in -1..1 of a whole file."""
    layout = read_layout(io.BytesIO(data))
    return layout.rate, layout.mono(data[layout.start : layout.start + layout.frames * layout.frame_bytes])


def wav_info(files: DataFrame) -> DataFrame:
    """``path, sample_rate, n_samples, duration_ms, peak, error`` of files with ``path, content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rate, samples = parse_wav(bytes(content or b""))
                    out.append((path, rate, len(samples), len(samples) * 1000 // rate if rate else 0, float(np.abs(samples).max(initial=0.0)), None))
                except ValueError as e:
                    out.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "n_samples", "duration_ms", "peak", "error"]).astype({"sample_rate": "Int64", "n_samples": "Int64", "duration_ms": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate long, n_samples long, duration_ms long, peak double, error string")


def byte_range(header: Column, total: Column) -> Column:
    """A range header over ``total`` bytes: struct (kind, start, length).

    ``partial`` for ``a-b``, ``a-`` and ``-n``, cut to what is there;
    ``unsatisfiable`` if nothing is; ``full`` for no or another kind of header.
    """
    spec = F.regexp_extract(F.trim(header), "^bytes=([0-9]*)-([0-9]*)$", 1), F.regexp_extract(F.trim(header), "^bytes=([0-9]*)-([0-9]*)$", 2)
    a, b = (F.nullif(x, F.lit("")).cast("long") for x in spec)
    usable = F.coalesce(header.rlike("^\\s*bytes=([0-9]+-[0-9]*|-[0-9]+)\\s*$"), F.lit(False))
    start = F.when(a.isNull(), F.greatest(total - b, F.lit(0))).otherwise(a)
    end = F.when(a.isNull(), total - 1).otherwise(F.least(F.coalesce(b, total - 1), total - 1))
    none = (start >= total) | (end < start) | (a.isNull() & (b == 0))
    whole = F.struct(F.lit("full").alias("kind"), F.lit(0).cast("long").alias("start"), total.cast("long").alias("length"))
    refused = F.struct(F.lit("unsatisfiable").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    part = F.struct(F.lit("partial").alias("kind"), start.cast("long").alias("start"), (end - start + 1).cast("long").alias("length"))
    return F.when(~usable, whole).when(none, refused).otherwise(part)


def read_range(content: Column, span: Column) -> Column:
    return F.substring(content, (span["start"] + 1).cast("int"), span["length"].cast("int"))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def extension(asked: Column, media_type: Column) -> Column:
    """The extension asked for without dots, else that of the media type, else ``m4a``."""
    own = F.nullif(F.lower(F.regexp_replace(F.trim(asked), "^\\.+", "")), F.lit(""))
    bare = F.lower(F.trim(F.regexp_extract(F.coalesce(media_type, F.lit("")), "^([^;]*)", 1)))
    return F.coalesce(own, _looked_up(EXTENSIONS, bare), F.lit("m4a"))


def media_type(ext: Column) -> Column:
    return F.coalesce(_looked_up(MEDIA_TYPES, F.lower(ext)), F.lit("application/octet-stream"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``<recording>/segments/<seq>.<ext>`` as ``recording_id, seq, storage_key, bytes, sha256, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pattern = "([^/]+)/segments/([0-9]+)\\.[^/.]+$"
    return files.select(
        F.regexp_extract("path", pattern, 1).alias("recording_id"), F.regexp_extract("path", pattern, 2).cast("int").alias("seq"), F.regexp_extract("path", "([^/]+/segments/[^/]+)$", 1).alias("storage_key"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content",
    ).where("recording_id <> ''")


def ingested(files: DataFrame, blobs: str, now: Column, title: Column | None = None, participants: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take in whole files (path, content; also named by ``title`` and ``participants``): recordings, segments and jobs to add.

    Each file is copied to ``<recording_id>/segments/000001.<ext>`` below ``blobs``
    as the first and only segment of a new recording, which is processed at once:
    a transcode job is to be enqueued.  Ids come from path and content, so taking in
    the same file again makes no other recording.  A file without content is an error.
    """
    titled, expected = F.lit(None).cast("string") if title is None else title, F.lit(None).cast("int") if participants is None else participants
    digest = F.sha2(F.concat(F.col("path").cast("binary"), F.lit(b"\0"), F.col("content")), 256)
    groups = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    ext = F.coalesce(F.nullif(F.regexp_extract("path", "[^/.][^/]*\\.([^./]+)$", 1), F.lit("")), F.lit("bin"))
    content = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "path"))).otherwise(F.col("content"))
    own = files.select(F.concat_ws("-", *groups).alias("recording_id"), titled.alias("title"), expected.alias("participants_expected"), ext.alias("audio_format"), content.alias("content"))
    key = F.concat("recording_id", F.lit("/segments/000001."), "audio_format")
    write_files(own.select(key.alias("name"), "content"), blobs)
    recordings = own.select("recording_id", "title", "participants_expected", "audio_format", F.col("recording_id").alias("storage_key"), F.lit("processing").alias("status"), now.alias("created_at"))
    segments = own.select("recording_id", F.lit(1).alias("seq"), key.alias("storage_key"), F.lit(0).cast("long").alias("start_ms"), F.octet_length("content").cast("long").alias("bytes"))
    jobs = own.select("recording_id", F.lit("transcode").alias("kind"), F.lit("{}").alias("payload"))
    return recordings, segments, jobs


def received(files: DataFrame, recordings: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Segments that came in, as rows to upsert, and the live jobs to enqueue for them.

    ``files`` has recording_id, seq, storage_key, content.  Only recordings that
    are there count; one that is still uploading gets a live job for each segment.
    """
    own = files.join(recordings.select("recording_id", "status"), "recording_id")
    rows = own.select("recording_id", "seq", "storage_key", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), now.alias("uploaded_at"))
    jobs = own.where("status = 'uploading'").select("recording_id", F.lit("transcribe_segment").alias("kind"), F.lit(0).alias("priority"), F.to_json(F.struct("seq")).alias("payload"))
    return rows, jobs


def joined_samples(segments: DataFrame, sample_rate: int = 16_000, sample_bytes: int = 2) -> DataFrame:
    """``recording_id, content, duration_ms``: raw samples of a recording's segments laid end to end by ``seq``, and how long they last."""
    parts = F.sort_array(F.collect_list(F.struct("seq", F.hex("content").alias("x"))))
    whole = segments.groupBy("recording_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("content"))
    n = F.floor(F.octet_length("content") / sample_bytes)
    return whole.withColumn("duration_ms", F.floor(n * 1000 / sample_rate))


def joined_audio(segments: DataFrame) -> DataFrame:
    """``recording_id, duration_ms, n_segments`` of segments that are WAV; :func:`.wav_source.concatenated` lays them end to end."""
    info = wav_info(segments.select(F.concat_ws("/", "recording_id", F.lpad(F.col("seq").cast("string"), 6, "0")).alias("path"), "content"))
    rows = info.where("error IS NULL").select(F.regexp_extract("path", "^(.*)/[0-9]+$", 1).alias("recording_id"), "duration_ms")
    return rows.groupBy("recording_id").agg(F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("n_segments"))
