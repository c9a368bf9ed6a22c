import hashlib
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.sources import audio
from colloquy.sources.file_sink import NamedFiles, NamedFilesWriter, write_files, written_files
from colloquy.sources.wav_source import WavFrames, WavReader, concatenated


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file() and not str(p.relative_to(folder)).startswith("_manifests")}


def wav(samples, rate=8000, bits=16, channels=1, extra=b""):
    """A file of integer samples; with a chunk before the data if asked for."""
    width = bits // 8
    body = b"".join(int(s + (128 if bits == 8 else 0)).to_bytes(width, "little", signed=bits > 8) for s in samples)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * width * channels, width * channels, bits)
    middle = (b"LIST" + struct.pack("<I", len(extra)) + extra + b"\0" * (len(extra) % 2)) if extra else b""
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + head + middle + b"data" + struct.pack("<I", len(body)) + body


def test_files_by_name(spark, tmp_path):
    rows = [("a/one.txt", "é\n", 0), ("b.bin", "x" * 100_000, 1), ("b.bin", "y", 0), ("b.bin", "", 2), ("empty", "", 0), ("null", None, 0)]
    df = spark.createDataFrame(rows, "name string, content string, piece int")
    write_files(df, str(tmp_path), "piece")
    want = {"a/one.txt": "é\n".encode(), "b.bin": b"y" + b"x" * 100_000, "empty": b"", "null": b""}
    assert files(tmp_path) == want
    listed = {r["name"]: (r["bytes"], r["sha256"]) for r in written_files(spark, str(tmp_path)).collect()}
    assert listed == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in want.items()}
    # again: a name is replaced, others stay
    write_files(spark.createDataFrame([("empty", bytearray(b"now"))], "name string, content binary"), str(tmp_path))
    assert files(tmp_path) == want | {"empty": b"now"}
    assert written_files(spark, str(tmp_path)).where("name = 'empty'").first()["bytes"] == 3
    write_files(df.limit(0), str(tmp_path))
    assert len(files(tmp_path)) == 4


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    write_files(spark.createDataFrame([("kept", "1")], "name string, content string"), str(tmp_path))
    bad = F.udf(lambda i: 1 // (int(i) - 77) and "text")
    df = spark.range(200).select(F.concat(F.lit("f"), "id").alias("name"), bad(F.col("id")).alias("content"))
    with pytest.raises(Exception, match="ZeroDivision"):
        write_files(df, str(tmp_path))
    for name in ("../out", "", "/x", "_manifests/x"):
        with pytest.raises(Exception, match="not a name"):
            write_files(spark.createDataFrame([("fine", "1"), (name, "1")], "name string, content string").coalesce(1), str(tmp_path))
    assert files(tmp_path) == {"kept": b"1"} and not (tmp_path / "_staging").exists()


def test_an_attempt_that_is_not_committed_is_dropped(tmp_path):
    from pyspark.sql import Row

    writer = NamedFilesWriter(str(tmp_path))
    first, second = writer.write(iter([Row(name="a", content="lost")])), writer.write(iter([Row(name="a", content="kept")]))
    assert first.manifest != second.manifest and files(tmp_path).keys() and "a" not in files(tmp_path)
    writer.commit([second, None])
    assert files(tmp_path) == {"a": b"kept"}


def test_the_sink_says_what_it_needs(spark, tmp_path):
    spark.dataSource.register(NamedFiles)
    df = spark.createDataFrame([("a", "b")], "name string, text string")
    for rows, mode in ((df, "append"), (df.withColumnRenamed("text", "content"), "overwrite")):
        with pytest.raises(Exception, match="named files|rows need"):
            rows.write.format("named_files").mode(mode).option("path", str(tmp_path)).save()


def test_wav_files_in_ranges_of_frames(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    want = {}
    for k, (bits, channels) in enumerate([(8, 1), (16, 1), (16, 2), (24, 3), (32, 1)]):
        n = [0, 1, 999, 1000, 2501][k] * channels
        raw = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), n)
        (tmp_path / "deep").mkdir(exist_ok=True)
        content = wav(raw, 8000 + k, bits, channels, extra=b"odd" if k % 2 else b"")
        (tmp_path / ("deep" if k % 2 else ".") / f"{k}.wav").write_bytes(content)
        rate, samples = audio.parse_wav(content)
        assert rate == 8000 + k and np.allclose(samples, (raw.reshape(-1, channels) / (1 << (bits - 1))).mean(axis=1) if n else [])
        if len(samples):
            want[f"{k}.wav"] = samples
    (tmp_path / "note.txt").write_text("no sound")
    monkeypatch.setattr("colloquy.sources.wav_source.ROW_FRAMES", 400)
    parts = WavReader(str(tmp_path), 1000).partitions()
    assert sorted(p.frames for p in parts) == [1, 501, 999, 1000, 1000, 1000]
    spark.dataSource.register(WavFrames)
    df = spark.read.format("wav").option("frames", 1000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 6
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["first_frame"])):
        name = r["path"].split("/")[-1]
        assert r["first_frame"] == len(got.setdefault(name, [])) and r["sample_rate"] == 8000 + int(name[0])
        got[name] += r["samples"]
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_many_small_wav_files_share_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("colloquy.sources.wav_source.GROUP_FILES", 8)
    monkeypatch.setattr("colloquy.sources.wav_source.GROUP_BYTES", 4000)
    for k in range(30):
        (tmp_path / f"{k:02}.wav").write_bytes(wav(range(k, 10 * k)))
    (tmp_path / "long.wav").write_bytes(wav([7] * 5000))
    reader = WavReader(str(tmp_path), 100)
    parts = reader.partitions()
    # 50 ranges of the long file; the small ones are a few groups
    assert len(parts) < 50 + 12
    got = {}
    for batch in (b for p in parts for b in reader.read(p)):
        for r in batch.to_pylist():
            assert len(r["samples"]) <= 100 and r["first_frame"] % 100 == 0
            got.setdefault(r["path"].split("/")[-1], {})[r["first_frame"]] = r["samples"]
    assert {n: [round(x * 32768) for first in sorted(rows) for x in rows[first]] for n, rows in got.items()} == {f"{k:02}.wav": list(range(k, 10 * k)) for k in range(1, 30)} | {"long.wav": [7] * 5000}


def test_segments_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = {(r, s): rng.integers(-32768, 32768, int(rng.integers(0, 3000))) for r in (1, 2) for s in range(12)}
    rows = [(r, s, bytearray(wav(x))) for (r, s), x in parts.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(r), int(s), c) for r, s, c in rows], "recording_id long, seq int, content binary").repartition(5)
    made = {r["recording_id"]: (r["storage_key"], r["duration_ms"], r["n_segments"]) for r in concatenated(df, str(tmp_path)).collect()}
    for rec in (1, 2):
        want = np.concatenate([parts[rec, s] for s in range(12)])
        rate, samples = audio.parse_wav((tmp_path / f"{rec}/audio.wav").read_bytes())
        assert rate == 8000 and np.array_equal(np.round(samples * 32768), want)
        assert made[rec] == (f"{rec}/audio.wav", len(want) * 1000 // 8000, 12)


@pytest.mark.parametrize("rows", [[(1, 0, wav([1])), (1, 1, wav([1], rate=9000))], [(1, 0, wav([1])), (1, 0, wav([2]))], [(1, 0, b"no sound")]])
def test_segments_that_do_not_fit(spark, tmp_path, rows):
    df = spark.createDataFrame([(r, s, bytearray(c)) for r, s, c in rows], "recording_id long, seq int, content binary")
    with pytest.raises(Exception, match="sample rates|one number|not a WAV"):
        concatenated(df, str(tmp_path)).collect()
    assert files(tmp_path) == {}


def test_files_taken_in_twice_are_one_recording(spark, tmp_path):
    rows = [("/a/talk.m4a", bytearray(b"one")), ("/a.b/talk", bytearray(b"")), ("/a/.hidden", bytearray(b"x"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    now = F.lit("2024-01-01").cast("timestamp")
    first, segments, jobs = audio.ingested(df, str(tmp_path), now, title=F.lit("T"), participants=F.lit(2))
    again = audio.ingested(df, str(tmp_path), now)[0]
    ids = {r["recording_id"]: r["audio_format"] for r in first.collect()}
    assert sorted(ids.values()) == ["bin", "bin", "m4a"] and ids.keys() == {r["recording_id"] for r in again.collect()}
    assert files(tmp_path).keys() == {f"{i}/segments/000001.{e}" for i, e in ids.items()} == {r["storage_key"] for r in segments.collect()}
    assert {(r["kind"], r["recording_id"]) for r in jobs.collect()} == {("transcode", i) for i in ids}
    with pytest.raises(Exception, match="no such file"):
        audio.ingested(spark.createDataFrame([("/gone", None)], "path string, content binary"), str(tmp_path), now)
