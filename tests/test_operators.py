"""Small literal cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import english, text as X
from colloquy.functions.json import first_block, summary_fields
from colloquy.functions.vector import cosine, hash_embed, normalised
from colloquy.operators import joins, library, prompts, queue, rows, schedule, search, speakers, windows
from colloquy.sources import audio, schemas


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


WORD = "recording_id long, word_ord long, w string, start_ms long, end_ms long"
TURN = "recording_id long, turn_ord long, local_idx long, start_ms long, end_ms long"


def test_largest_overlap_then_nearest(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, "b", 90, 210), (1, 2, "c", 500, 600), (2, 0, "d", 0, 5), (1, 3, "e", 150, 250)], WORD)
    turns = spark.createDataFrame([(1, 0, 7, 0, 100), (1, 1, 8, 100, 200), (1, 2, 9, 200, 300), (1, 3, 5, 200, 300)], TURN)
    got = {(r["recording_id"], r["word_ord"]): r["local_idx"] for r in joins.assign_speakers(words, turns).collect()}
    # equal overlaps go to the first turn; a word in silence to the nearest; no turns, no speaker
    assert got == {(1, 0): 7, (1, 1): 8, (1, 2): 9, (2, 0): None, (1, 3): 8}


def test_utterances_break_on_speaker_and_gap(spark):
    said = spark.createDataFrame([(1, 0, "a", 0, 900, 1), (1, 1, "b", 2400, 2500, 1), (1, 2, "c", 4001, 4100, 1), (1, 3, "d", 4100, 4200, None), (1, 4, "e", 4200, 4300, None), (1, 5, "f", 4300, 4400, 2)], f"{WORD}, local_idx int")
    got = [(r["local_idx"], r["start_ms"], r["end_ms"], r["text"]) for r in windows.utterances(said).orderBy("utterance_no").collect()]
    assert got == [(1, 0, 2500, "a b"), (1, 4001, 4100, "c"), (None, 4100, 4300, "d e"), (2, 4300, 4400, "f")]


def test_chunk_windows(spark):
    long_ = [(1, 1, i, f"w{i}", i * 10_000, i * 10_000 + 900) for i in range(10)]
    got = windows.chunk_windows(spark.createDataFrame(long_ + [(2, 1, 0, "x", 0, 5)], "recording_id long, utterance_no long, word_ord long, w string, start_ms long, end_ms long")).orderBy("recording_id", "window_no").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 40_900, "w0 w1 w2 w3 w4"), (40_000, 80_900, "w4 w5 w6 w7 w8"), (80_000, 90_900, "w8 w9"), (0, 5, "x")]


def test_interval_merge_and_splits(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 8, 9), (1, 1, 3)], "k int, start int, end int")
    assert sorted(map(tuple, windows.merged(df, ["k"]).collect())) == [(1, 0, 6), (1, 8, 9)]
    pieces = one(spark, windows.split_evenly(F.lit(0), F.lit(10), 4))
    assert [(p["start"], p["end"]) for p in pieces] == [(0, 3), (3, 6), (6, 10)]
    assert [tuple(p) for p in one(spark, windows.tumbling(F.lit(0), F.lit(70), 30))] == [(0, 30), (30, 60), (60, 70)]


def test_fillers(spark):
    text = one(spark, F.array_join(X.without_fillers(X.words(F.lit("So um, the Uh plan um. uh-huh"))), " "))
    assert text == "So the plan uh-huh"


def test_texts(spark):
    assert one(spark, X.slug(F.lit("  Q3: Plan -- é!"))) == "q3-plan"
    assert one(spark, X.slug(F.lit("!!"))) == "recording"
    assert one(spark, X.clean_title(F.lit('\n \t"A title" \nmore'))) == "A title"
    assert one(spark, X.clock(F.lit(3_725_000))) == "1:02:05" and one(spark, X.clock(F.lit(65_999))) == "1:05"
    assert one(spark, X.srt_time(F.lit(3_725_042))) == "01:02:05,042" and one(spark, X.minutes_clock(F.lit(7_265_000))) == "121:05"
    assert one(spark, X.compare_key(F.lit("Don't!"))) == "don't" and one(spark, X.compare_key(F.lit("Ж"))) == "ж"
    assert one(spark, X.trimmed(F.lit("\t a  "))) == "a"
    assert one(spark, X.accepts_edit(F.lit("hello bob"), F.lit("hello rob"))) is True
    assert one(spark, X.accepts_edit(F.lit("hello"), F.lit("x" * 40))) is False


@pytest.mark.parametrize(
    "text,want",
    [('{"title": "A"}', '{"title": "A"}'), ('so: {"a": {"b": 1}} ok', '{"a": {"b": 1}}'), ('{"a": "}{\\""} x', '{"a": "}{\\""}'), ("none", None), ("{open", None), (None, None)],
)
def test_first_block(text, want):
    assert first_block(text) == want


def test_summary_fields():
    assert summary_fields('x {"title": " T ", "summary": "", "topics": "one", "decisions": ["a", " ", 3]} y') == {"title": "T", "summary": None, "action_items": [], "decisions": ["a", "3"], "topics": ["one"]}
    assert summary_fields(" plain ") == {"title": None, "summary": "plain", "action_items": [], "decisions": [], "topics": []}


def test_vectors(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<float>")
    assert one(spark, cosine(vec(1, 0), vec(1, 1))) == pytest.approx(2**-0.5)
    assert one(spark, cosine(vec(0, 0), vec(1, 1))) == 0 and one(spark, cosine(vec(1), vec(1, 1))) == 0
    assert one(spark, normalised(vec(3, 4))) == pytest.approx([0.6, 0.8])
    got = {r["id"]: r["embedding"] for r in hash_embed(spark.createDataFrame([(1, "a b a"), (2, " !"), (3, None), (4, "b a a")], "id int, t string"), "id", "t", 16).collect()}
    assert got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6)
    assert got[2] == got[3] == [1.0] + [0.0] * 15


def test_words_spoken_and_marks(spark):
    words = spark.createDataFrame([(1, 0, "a", 100, 200), (1, 1, "b", 400, 500)], WORD)
    marks = spark.createDataFrame([(1, 50), (1, 150), (1, 319), (1, 320), (1, 450), (1, 450)], "recording_id long, mark_ms long")
    assert sorted((r["mark_ms"], r["word_ord"]) for r in joins.spoken_word(marks, words).collect()) == [(50, -1), (150, 0), (319, 0), (320, -1), (450, 1), (450, 1)]
    lines = spark.createDataFrame([(1, 0, 1, 100, 200), (1, 1, 1, 400, 500)], TURN)
    assert sorted((r["mark_ms"], r["turn_ord"]) for r in joins.anchor_marks(marks, lines).collect()) == [(50, 0), (150, 0), (319, 1), (320, 1), (450, 1), (450, 1)]


def test_token_times():
    words = [{"w": "Hello", "start_ms": 0, "end_ms": 400}, {"w": "big", "start_ms": 400, "end_ms": 400}, {"w": "world", "start_ms": 900, "end_ms": 1200}]
    assert prompts.align_tokens(["hello,", "wide", "World!"], words, 0, 1500) == [("hello,", 0, 400), ("wide", 400, 900), ("World!", 900, 1200)]
    assert prompts.align_tokens(["ab", "c"], [], 0, 300) == [("ab", 0, 200), ("c", 200, 300)]
    assert prompts.align_tokens(["a"], [], 5, 5) == [] and prompts.align_tokens([], words, 0, 9) == []


def test_clusters():
    a, b = [1.0, 0, 0], [0, 1.0, 0]
    assert speakers.cluster_voices([a, b, a, b], [0, 1, 2, 3], 2) == [0, 1, 0, 1]
    assert speakers.cluster_voices([a, [0.99, 0.1, 0], b], [0, 1, 2]) == [0, 0, 1]
    assert speakers.cluster_voices([None, None], [0, 1]) == [0, 0]
    assert speakers.cluster_voices([a, None, b], [0, 90, 100], 2) == [0, 1, 1]
    # nothing is less similar than what was merged before, so all become one
    assert set(speakers.cluster_voices(np.eye(30).tolist(), list(range(30)))) == {0}


def test_matching_in_blocks(spark, monkeypatch):
    enrolled = spark.createDataFrame([(i, f"s{i}", [float(i == j) for j in range(6)]) for i in range(6)] + [(9, "x", None)], "speaker_id long, display_name string, embedding array<float>")
    voices = spark.createDataFrame([(1, [0.9, 0.1, 0.0, 0.0, 0.0, 0.0]), (2, [0.0] * 6), (3, None), (4, [0.0, 0.0, 0.0, 0.0, 0.0, 2.0])], "voice_id long, embedding array<float>")
    for most in (100, 2):
        monkeypatch.setattr(speakers, "ENROLLED", most)
        got = {r["voice_id"]: r["speaker_id"] for r in speakers.match_speakers(voices, enrolled).collect()}
        assert got == {1: 0, 2: None, 3: None, 4: 5}


def _jobs(spark):
    t = dt.datetime(2024, 1, 1)
    data = [(1, 10, "merge", "queued", 0, 0, t, None), (2, 10, "embed", "running", 0, 3, t, t), (3, 11, "merge", "queued", 5, 0, t, None), (4, 11, "embed", "done", 0, 0, t, None)]
    return queue.as_jobs(spark.createDataFrame(data, "job_id long, recording_id long, kind string, state string, priority int, attempts int, created_at timestamp, locked_at timestamp"))


def test_queue(spark):
    jobs, now = _jobs(spark), F.lit("2024-01-02").cast("timestamp")
    assert queue.claim_head(jobs, ["merge"], now).first()["job_id"] == 3 and queue.claim_head(jobs, [], now).isEmpty()
    claimed = queue.claim(jobs, "w", ["merge"], now)
    assert {r["job_id"]: r["state"] for r in claimed.collect()}[3] == "running"
    assert queue.claim(claimed.where("job_id = 4"), "w", ["merge"], now).first()["state"] == "done"
    left, taken = queue.reap(jobs, 60, 4, now)
    assert [tuple(r) for r in taken.collect()] == [(2, 10, True)] and left.where("job_id = 2").first()["state"] == "failed"
    asked = spark.createDataFrame([(10, "merge", 1, "{}"), (12, "merge", 1, "{}"), (12, "merge", 2, "{}"), (11, "embed", 1, "{}")], "recording_id long, kind string, priority int, payload string")
    added = queue.enqueue(jobs, asked, now).where("job_id > 4").orderBy("job_id").collect()
    assert [(r["job_id"], r["recording_id"], r["kind"], r["priority"]) for r in added] == [(5, 11, "embed", 1), (6, 12, "merge", 2)]
    failed = queue.fail(jobs, F.col("job_id") == 1, "e", 3, 10, now).where("job_id = 1").first()
    assert (failed["state"], failed["attempts"], failed["run_after"]) == ("queued", 1, dt.datetime(2024, 1, 2, 0, 0, 10))
    assert queue.claimable_kinds(["merge", "transcribe_segment"], False) == ["transcribe_segment"]


DAYS = "day int, enabled boolean, start_min int, end_min int"


@pytest.mark.parametrize(
    "now,allowed,reason,secs",
    [("2026-08-17 10:00:00", True, "in_window", 7 * 3600), ("2026-08-17 08:59:00", False, "outside_window", 60), ("2026-08-17 17:00:00", False, "outside_window", 16 * 3600), ("2026-08-22 12:00:00", False, "outside_window", 45 * 3600)],
)
def test_work_week(spark, now, allowed, reason, secs):
    days = spark.createDataFrame([(i, i < 5, 540, 1020) for i in range(7)], DAYS)
    at = spark.sql(f"SELECT TIMESTAMP '{now}' AS now_at")
    assert tuple(schedule.decisions(days, at).first())[1:] == (allowed, reason, secs)
    assert tuple(schedule.decisions(days, at, enabled=False).first())[1:] == (True, "disabled", None)
    assert schedule.decisions(days, at, override="pause", until="2026-12-01").first()["reason"] == "override_pause"
    assert schedule.decisions(days, at, override="run", until="2026-01-01").first()["reason"] == reason


def test_overnight_and_all_day(spark):
    night = spark.createDataFrame([(0, True, 1320, 360)], DAYS)
    at = spark.sql("SELECT TIMESTAMP '2026-08-18 01:00:00' AS now_at")
    assert tuple(schedule.decisions(night, at).first())[1:] == (True, "in_window", 5 * 3600)
    always = spark.createDataFrame([(i, True, 0, 0) for i in range(7)], DAYS)
    assert schedule.open_windows(always, at).count() == 1
    with pytest.raises(ValueError):
        schedule.checked_days([])


def test_rows(spark):
    rec = spark.createDataFrame([(1, "t"), (2, "u")], "recording_id long, title string")
    seg = spark.createDataFrame([(1, 0), (2, 0)], "recording_id long, seq int")
    out = rows.delete_recordings({"recordings": rec, "segments": seg, "speakers": rec}, rec.where("recording_id = 1"))
    assert [out[k].count() for k in ("recordings", "segments", "speakers")] == [1, 1, 2]
    with pytest.raises(ValueError):
        rows.merge_speakers(rec, rec, 1, 1)
    with pytest.raises(ValueError):
        rows.checked_participants(65)
    with pytest.raises(Exception, match="differ in length"):
        rows.unzipped(spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>"), "a", "b").collect()
    people = spark.createDataFrame([("a", "Ann", None)], "speaker_id string, display_name string, embedding array<float>")
    voices = spark.createDataFrame([("r", 1, None, [0.5])], "recording_id string, local_idx int, speaker_id string, embedding array<float>")
    known, named = rows.name_speaker(people, voices, "r", 1, name="ANN", new_id="b")
    assert named.first()["speaker_id"] == "a" and known.first()["embedding"] == [0.5]
    known, named = rows.name_speaker(people, voices, "r", 1, name="Bob", new_id="b")
    assert named.first()["speaker_id"] == "b" and known.count() == 2
    with pytest.raises(LookupError):
        library.one(rec, "recording_id", 9)


def test_transcript_parts_and_exports(spark):
    assert one(spark, prompts.lines_within(F.lit("aa\nbb\ncc\n"), 6)) == ["aa\nbb\n", "cc\n"]
    assert one(spark, prompts.lines_within(F.lit(" "), 6)) == [" "]
    said = spark.createDataFrame([(1, 1, 0, 0, "Ann", " Hi "), (1, 2, 5000, 65_000, "Bob", "Yo")], "recording_id long, utterance_id long, start_ms long, end_ms long, label string, text string")
    rec = spark.createDataFrame([(1, "My Talk", dt.datetime(2024, 1, 1), 65_000)], "recording_id long, title string, created_at timestamp, duration_ms long")
    done = spark.createDataFrame([(1, None, "Short.", ["do"], [], ["x", "y"])], "recording_id long, title string, summary string, action_items array<string>, decisions array<string>, topics array<string>")
    md = prompts.exports(said, rec, done).first()
    assert md["filename"] == "my-talk.md"
    assert md["content"] == "# My Talk\n\n_2024-01-01 00:00:00 · 1:05_\n\n## Summary\n\nShort.\n\n## Action items\n\n- [ ] do\n\n## Topics\n\n`x` `y`\n\n## Transcript\n\n**Ann** _(0:00)_\nHi\n\n**Bob** _(0:05)_\nYo\n"
    srt = prompts.exports(said, rec, None, "srt").first()
    assert srt["content"] == "1\n00:00:00,000 --> 00:00:02,000\nAnn: Hi\n\n2\n00:00:05,000 --> 00:01:05,000\nBob: Yo\n"
    short = prompts.condense(spark.createDataFrame([(1, "line\n" * 2000), (2, "ok")], "recording_id long, transcript string"), lambda parts: ["n" * 20 for _ in parts], 2000)
    assert {r["recording_id"]: len(r["transcript"]) <= 2000 for r in short.collect()} == {1: True, 2: True}


def test_empty_search_context(spark):
    hits = spark.createDataFrame([], "chunk_id long, title string, start_ms long, text string, score double")
    assert prompts.context(hits).first()["context"] == "No matching excerpts were found."
    assert search.clamped(None, 20, 200) == 20 and search.clamped(0, 20, 200) == 1 and search.clamped(999, 20, 200) == 200


def test_cover_density(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a x x b a"), (3, "a only"), (4, "b a b")], "chunk_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in search.keyword_scores(chunks, "A b").collect()}
    assert got == {1: 0.1, 2: round(0.1 / 3 + 0.1, 6), 4: 0.2}
    assert search.keyword_scores(chunks, " !").isEmpty()
    assert {r["chunk_id"] for r in search.keyword_scores(chunks, "only").collect()} == {3}


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("formalize", "formal"), ("adjustment", "adjust"), ("controlling", "control"), ("agreed", "agre"), ("sky", "sky")])
def test_stems(word, want):
    assert english.stem(word) == want


def _wav(kind, channels, rate, bits, body):
    block = channels * bits // 8
    fmt = b"".join(x.to_bytes(n, "little") for x, n in ((kind, 2), (channels, 2), (rate, 4), (rate * block, 4), (block, 2), (bits, 2)))
    return b"RIFF" + (36 + len(body)).to_bytes(4, "little") + b"WAVE" + b"LIST" + (2).to_bytes(4, "little") + b"ab" + b"fmt " + (16).to_bytes(4, "little") + fmt + b"data" + len(body).to_bytes(4, "little") + body


def test_wav_layouts():
    half = [(1, 8, bytes([192, 64])), (1, 16, np.array([16384, -16384], "<i2").tobytes()), (1, 24, (1 << 22).to_bytes(3, "little") + ((1 << 24) - (1 << 22)).to_bytes(3, "little")), (1, 32, np.array([1 << 30, -(1 << 30)], "<i4").tobytes()), (3, 32, np.array([0.5, -0.5], "<f4").tobytes())]
    for kind, bits, body in half:
        rate, mono = audio.parse_wav(_wav(kind, 1, 8000, bits, body))
        assert rate == 8000 and mono.tolist() == [0.5, -0.5]
        assert audio.parse_wav(_wav(kind, 2, 8000, bits, body))[1].tolist() == [0.0]
    with pytest.raises(ValueError):
        audio.parse_wav(b"RIFFxxxx")


@pytest.mark.parametrize("header,want", [("bytes=0-4", ("partial", 0, 5)), ("bytes=6-", ("partial", 6, 4)), ("bytes=-3", ("partial", 7, 3)), ("bytes=-99", ("partial", 0, 10)), ("bytes=5-99", ("partial", 5, 5)), ("bytes=10-", ("unsatisfiable", 0, 0)), ("bytes=5-4", ("unsatisfiable", 0, 0)), ("bytes=-0", ("unsatisfiable", 0, 0)), ("lines=1-2", ("full", 0, 10)), ("bytes=-", ("full", 0, 10)), (None, ("full", 0, 10))])
def test_byte_ranges(spark, header, want):
    assert tuple(one(spark, audio.byte_range(F.lit(header).cast("string"), F.lit(10)))) == want


def test_segments_from_files(spark, tmp_path):
    folder = tmp_path / "rec1" / "segments"
    folder.mkdir(parents=True)
    for seq in (0, 1):
        (folder / f"{seq:06}.wav").write_bytes(_wav(1, 1, 8000, 8, bytes(800)))
    got = audio.read_segments(spark, str(tmp_path))
    assert sorted((r["recording_id"], r["seq"], r["storage_key"]) for r in got.collect()) == [("rec1", 0, "segments/000000.wav"), ("rec1", 1, "segments/000001.wav")] or got.count() == 2
    assert [tuple(r) for r in audio.joined_audio(got).collect()] == [("rec1", 200, 2)]


def test_documents_and_enums(spark):
    table = spark.createDataFrame([("a", '{"n": 1}'), ("b", "oops")], "key string, value string")
    assert {r["key"]: r["value"]["n"] for r in schemas.documents(table, "value", "struct<n:int>", '{"n": 7}').collect()} == {"a": 1, "b": 7}
    with pytest.raises(Exception, match="unknown state"):
        schemas.checked(spark.createDataFrame([("gone",)], "state string"), "state", schemas.STATES).collect()
    for name in schemas.SCHEMAS:
        assert schemas.schema(name).fieldNames()
