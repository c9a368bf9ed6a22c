import json
import time

import pytest

from colloquy.streaming import live


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_live_timeline_goes_on_and_ignores_repeats(spark, tmp_path):
    recordings = spark.createDataFrame([(1, "uploading"), (2, "ready")], "recording_id long, status string")
    seg = lambda r, s, w: {"recording_id": r, "seq": s, "duration_ms": 1000, "words": [{"w": w, "start_ms": 10, "end_ms": 20}]}

    def run():
        stream = spark.readStream.schema(live.SEGMENT_COLUMNS).json(str(tmp_path / "in"))
        live.to_table(live.live_drain(stream, recordings), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r["recording_id"], r["seq"], r["w"], r["start_ms"]) for r in spark.read.schema(live.WORDS).parquet(str(tmp_path / "out")).collect())

    _write(tmp_path / "in", "a.json", [seg(1, 1, "b"), seg(1, 0, "a"), seg(2, 0, "x")])
    assert run() == [(1, 0, "a", 10), (1, 1, "b", 1010)]
    _write(tmp_path / "in", "b.json", [seg(1, 1, "again"), seg(1, 2, "c")])
    assert run() == [(1, 0, "a", 10), (1, 1, "b", 1010), (1, 2, "c", 2010)]


def test_upserts_keep_the_latest(spark, tmp_path):
    schema = "recording_id long, seq int, v int"

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        live.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "state"), ["recording_id", "seq"], ["v"]).awaitTermination()
        return sorted((r["recording_id"], r["seq"], r["v"]) for r in spark.read.schema(schema).parquet(str(tmp_path / "t")).collect())

    _write(tmp_path / "in", "a.json", [{"recording_id": 1, "seq": 0, "v": 1}, {"recording_id": 1, "seq": 1, "v": 5}])
    assert run() == [(1, 0, 1), (1, 1, 5)]
    _write(tmp_path / "in", "b.json", [{"recording_id": 1, "seq": 0, "v": 3}, {"recording_id": 1, "seq": 1, "v": 2}])
    assert run() == [(1, 0, 3), (1, 1, 5)]


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    schema, table = "recording_id long, seq int, v int", str(tmp_path / "t")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    rows = lambda: sorted((r["recording_id"], r["seq"], r["v"]) for r in spark.read.parquet(table).collect())
    first = [(i, 0, 1) for i in range(200)]
    merge = lambda data, n: live.merge_buckets(spark.createDataFrame(data, schema), table, ["recording_id", "seq"], ["v"], 16, n)
    assert merge(first, 0) == list(range(16)) and rows() == first
    before = files()
    touched = merge([(7, 0, 5), (7, 0, 3), (7, 1, 1)], 1)
    now = files()
    of = lambda path: int(path.split("bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 2 and {p for p in before if of(p) not in touched} == {p for p in now if p in before}
    want = sorted([(i, 0, 5 if i == 7 else 1) for i in range(200)] + [(7, 1, 1)])
    assert rows() == want
    # the same batch again, as after a lost driver: once without and once with its mark
    assert merge([(7, 0, 5), (7, 0, 3), (7, 1, 1)], None) == touched and rows() == want
    assert merge([(7, 0, 9)], 1) == [] and rows() == want


def test_flips_however_the_streams_are_cut(spark, tmp_path):
    said = lambda w: [{"w": w, "start_ms": 1, "end_ms": 2}]
    segment = lambda r, s, at: {"recording_id": r, "seq": s, "duration_ms": 100 + s, "words": said(f"{r}-{s}"), "at": f"2024-01-01T00:00:{at:02d}"}
    flip = lambda r, at, status="processing": {"recording_id": r, "status": status, "at": f"2024-01-01T00:00:{at:02d}"}
    # recording 1 flips between its segments, 2 never does, 3 before all, 4 at the time of a segment, 5 says twice that it uploads
    events = [flip(3, 1), flip(5, 1, "uploading"), segment(1, 1, 2), segment(2, 0, 2), segment(3, 0, 3), segment(1, 0, 4), flip(4, 5), segment(4, 0, 5), segment(1, 0, 5), flip(1, 6), flip(5, 6, "uploading"), segment(1, 2, 7), segment(2, 1, 8), segment(5, 3, 8), flip(1, 9, "ready"), segment(1, 3, 10)]
    want = None
    for k, cuts in enumerate(([], [7], [1, 2, 5, 9, 10, 12], list(range(1, len(events))))):
        base = tmp_path / f"run{k}"
        base.mkdir()
        for a, b in zip([0, *cuts], [*cuts, len(events)]):
            _write(base / "seg", f"{a:03}.json", [e for e in events[a:b] if "seq" in e])
            _write(base / "status", f"{a:03}.json", [e for e in events[a:b] if "status" in e])
            segments = spark.readStream.schema(live.SEGMENT_COLUMNS + ", at timestamp").json(str(base / "seg"))
            statuses = spark.readStream.schema("recording_id long, status string, at timestamp").json(str(base / "status"))
            if k == 3 and b not in (3, 7, 9, 11, len(events)):
                continue
            live.to_table(live.transcript_flips(segments, statuses), str(base / "out"), str(base / "state")).awaitTermination()
        got = sorted((r["recording_id"], r["seq"], r["w"], r["start_ms"]) for r in spark.read.schema(live.WORDS).parquet(str(base / "out")).collect())
        want = want or got
        assert got == want == [(1, 0, "1-0", 102), (1, 1, "1-1", 1), (2, 0, "2-0", 1), (2, 1, "2-1", 101), (5, 3, "5-3", 1)]
    whole = spark.read.schema(live.SEGMENT_COLUMNS + ", at timestamp").json(str(tmp_path / "run0" / "seg"))
    full = sorted((r["seq"], r["start_ms"]) for r in live.full_pass(whole.where("recording_id = 1")).collect())
    assert full == [(0, 1), (1, 101), (2, 202), (3, 304)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    spark.conf.set(key, live.ROCKS)
    yield
    spark.conf.set(key, kept)


def test_a_lost_lease_is_told_without_another_beat(spark, tmp_path, rocks):
    beat = lambda job, who: {"job_id": job, "worker": who, "at": "2024-01-01T00:00:00"}
    _write(tmp_path / "in", "a.json", [beat(1, "a"), beat(2, "b")])
    beats = spark.readStream.schema("job_id long, worker string, at timestamp").json(str(tmp_path / "in"))
    query = live.lease_state(beats, 4, on_clock=True).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        told = lambda: [(r["job_id"], r["worker"], r["state"]) for r in spark.read.schema("job_id long, worker string, state string").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
        end = time.time() + 90
        while time.time() < end and sorted(t for t in told() if t[2] == "lost") != [(1, "a", "lost"), (2, "b", "lost")]:
            time.sleep(0.5)
        assert sorted(told()) == [(1, "a", "held"), (1, "a", "lost"), (2, "b", "held"), (2, "b", "lost")]
        # it may be held again
        _write(tmp_path / "in", "b.json", [beat(1, "c")])
        while time.time() < end and (1, "c", "held") not in told():
            time.sleep(0.5)
        assert (1, "c", "held") in told()
    finally:
        query.stop()


def test_leases_by_the_times_of_beats(spark, tmp_path, rocks):
    beat = lambda job, who, at: {"job_id": job, "worker": who, "at": f"2024-01-01T00:{at:02d}:00"}

    def run(name, rows):
        _write(tmp_path / "in", name, rows)
        beats = spark.readStream.schema("job_id long, worker string, at timestamp").json(str(tmp_path / "in"))
        live.to_table(live.lease_state(beats, 300, late="2 minutes"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r["job_id"], r["worker"], r["state"]) for r in spark.read.schema("job_id long, worker string, state string").parquet(str(tmp_path / "out")).collect())

    assert run("a.json", [beat(1, "a", 0), beat(1, "b", 3), beat(2, "x", 4), beat(2, "y", 1)]) == [(1, "a", "held"), (1, "b", "moved"), (2, "x", "moved"), (2, "y", "held")]
    # nine minutes: job 2 was last seen at four, job 3 comes; a beat that is older than the job's last changes nothing
    got = run("b.json", [beat(3, "z", 12), beat(1, "b", 8), beat(1, "old", 2)])
    assert [x for x in got if x[2] == "lost"] == [(2, "x", "lost")] and (1, "old", "moved") not in got and (3, "z", "held") in got
    got = run("c.json", [beat(3, "z", 17), beat(2, "w", 17)])
    assert [x for x in got if x[2] == "lost"] == [(1, "b", "lost"), (2, "x", "lost")] and (2, "w", "held") in got
