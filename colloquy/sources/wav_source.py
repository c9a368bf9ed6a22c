"""WAV files as a data source that is read in ranges of frames, and as a sink of joined segments.

    spark.dataSource.register(WavFrames)
    spark.read.format("wav").option("frames", 480_000).load(folder)

gives ``path, sample_rate, first_frame, samples``: mono samples in -1..1, a row for
each ``ROW_FRAMES`` frames.  A partition is a range of at most ``frames`` frames of one
file, of which it reads those bytes alone; only the headers are read to make the
partitions.  Among more than ``GROUP_FILES`` files those of at most ``GROUP_BYTES`` share
partitions of about so many bytes and files, which read the headers too; their rows are the same.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .audio import WavLayout, parse_wav, read_layout
from .file_sink import opened, write_files

FRAMES, ROW_FRAMES = 960_000, 16_000
GROUP_FILES, GROUP_BYTES = 500, 32 << 20
#: Bytes of decoded segments that a task hands on together.
BATCH_BYTES = 4 << 20
SCHEMA = "path string, sample_rate int, first_frame long, samples array<float>"


@dataclass
class FrameRange(InputPartition):
    path: str
    layout: WavLayout
    first: int
    frames: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.first))


@dataclass
class FileGroup(InputPartition):
    files: list[str]
    frames: int

    def __post_init__(self) -> None:
        super().__init__(tuple(self.files))


class WavReader(DataSourceReader):
    def __init__(self, path: str, frames: int):
        self.path, self.frames = path.rstrip("/"), frames

    def _files(self, store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
        return sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(".wav") and not hidden(x.path))

    def partitions(self) -> list[FrameRange | FileGroup]:
        store, path = opened(self.path)
        files = self._files(store, path)
        many = len(files) > GROUP_FILES
        found, group, size = [], [], 0
        for file, length in files:
            if not many or length > GROUP_BYTES:
                found += _ranges(store, file, self.frames)
                continue
            if group and (size + length > GROUP_BYTES or len(group) == GROUP_FILES):
                found.append(FileGroup(group, self.frames))
                group, size = [], 0
            group.append(file)
            size += length
        return [*found, FileGroup(group, self.frames)] if group else found

    def read(self, part: FrameRange | FileGroup) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for range_ in [part] if isinstance(part, FrameRange) else (r for file in part.files for r in _ranges(store, file, part.frames)):
            with store.open_input_file(range_.path) as f:
                for first in range(range_.first, range_.first + range_.frames, ROW_FRAMES):
                    n = min(ROW_FRAMES, range_.first + range_.frames - first)
                    f.seek(range_.layout.start + first * range_.layout.frame_bytes)
                    samples = range_.layout.mono(f.read(n * range_.layout.frame_bytes)).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([range_.path]), pa.array([range_.layout.rate], pa.int32()), pa.array([first], pa.int64()), pa.array([samples], pa.list_(pa.float32()))], ["path", "sample_rate", "first_frame", "samples"]
                    )


def _ranges(store: fs.FileSystem, file: str, frames: int) -> list[FrameRange]:
    with store.open_input_file(file) as f:
        one = read_layout(f)
    return [FrameRange(file, one, first, min(frames, one.frames - first)) for first in range(0, one.frames, frames)]


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        frames = int(self.options.get("frames", FRAMES))
        if frames < 1:
            raise ValueError("frames must be 1 or more")
        return WavReader(self.options["path"], frames)


def wav_header(rate: int, samples: int) -> bytes:
    """The head of a mono file of 16 bits."""
    size = 2 * samples
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", size)


def concatenated(segments: DataFrame, path: str) -> DataFrame:
    """Lay the segments (recording_id, seq, content: WAV files) of each recording end to end by ``seq``.

    Writes ``<recording_id>/audio.wav`` below ``path``, mono with 16 bits, segment by
    segment, and returns ``recording_id, storage_key, duration_ms, n_segments``, as
    they are to be set on the recordings.  Segments that cannot be read, two of one
    ``seq``, or several sample rates in a recording are an error, as no part of a
    recording may be missing.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = [read_layout(io.BytesIO(content or b"")) for content in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.rate for x in layouts], pa.int32()), pa.array([x.frames for x in layouts], pa.int64())], ["recording_id", "seq", "rate", "n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["recording_id", "seq", "content"]
        for batch in batches:
            at, held, size = 0, [], 0
            for content in batch.column(2):
                pcm = np.clip(np.round(parse_wav(content.as_py() or b"")[1] * 32768), -32768, 32767).astype("<i2").tobytes()
                if held and size + len(pcm) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), pa.array(held, pa.binary())], names)
                    at, held, size = at + len(held), [], 0
                held.append(pcm)
                size += len(pcm)
            if held:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at), batch.column(1).slice(at), pa.array(held, pa.binary())], names)

    kind = segments.schema["recording_id"].dataType
    given = segments.select(F.col("recording_id").cast("string"), F.col("seq").cast("int"), "content")
    own = given.mapInArrow(decode, "recording_id string, seq int, content binary")
    measured = given.mapInArrow(measure, "recording_id string, seq int, rate int, n long")
    sizes = measured.groupBy("recording_id").agg(F.sum("n").alias("n"), F.min("rate").alias("rate"), F.max("rate").alias("most"), F.count("*").alias("n_segments"), F.count_distinct("seq").alias("seqs"))
    wrong = F.when(F.col("rate") != F.col("most"), F.raise_error(F.concat(F.lit("several sample rates in recording "), "recording_id"))).when(F.col("n_segments") != F.col("seqs"), F.raise_error(F.concat(F.lit("segments of one number in recording "), "recording_id")))
    sizes = sizes.where(wrong.isNull())
    key = F.concat("recording_id", F.lit("/audio.wav"))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [wav_header(rate, n) for rate, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1] * len(heads), pa.int64()), pa.array(heads, pa.binary())], ["name", "piece", "content"])

    heads = sizes.select(key.alias("name"), "rate", "n").mapInArrow(head, "name string, piece long, content binary")
    pieces = own.select(key.alias("name"), F.col("seq").cast("long").alias("piece"), "content")
    write_files(heads.unionByName(pieces), path, "piece")
    return sizes.select(F.col("recording_id").cast(kind).alias("recording_id"), key.alias("storage_key"), F.floor(F.col("n") * 1000 / F.col("rate")).alias("duration_ms"), "n_segments")
