import uuid
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import prompts


def counting(folder):
    """A model that leaves a file for every prompt it is asked."""

    def model(parts):
        for p in parts:
            (folder / uuid.uuid4().hex).write_text(p)
        return [f"{p[:40].strip()} [{uuid.uuid4().hex}]" for p in parts]

    return model


def asked(folder):
    return Counter(p.read_text() for p in folder.iterdir())


def test_corrections_are_those_of_the_numbered_lines(spark):
    said = spark.createDataFrame([(1, 10, "my name is jon"), (1, 11, "  "), (1, 12, "I met bobb"), (2, 20, "alone"), (3, 30, "no answer")], "recording_id long, utterance_id long, text string")
    lines = {r["recording_id"]: r["lines"] for r in prompts.numbered_lines(said).collect()}
    assert lines == {1: "0: my name is jon\n2: I met bobb", 2: "0: alone", 3: "0: no answer"}
    answers = spark.createDataFrame(
        [(1, 'ok [{"i": 0, "text": " my name is John "}, {"i": 2, "text": "I met Bob"}, {"i": 2, "text": "' + "x" * 90 + '"}, {"i": 2, "text": "I met Bob again"}, {"i": 7, "text": "nobody"}] done'), (2, "sorry, [none]")], "recording_id long, answer string"
    )
    got = sorted((r["utterance_id"], r["text"], r["edited"]) for r in prompts.corrected(said, answers).collect())
    # the last correction is measured against the one taken before it
    assert got == [(10, "my name is John", True), (11, "  ", False), (12, "I met Bob again", True), (20, "alone", False), (30, "no answer", False)]


def test_an_edit_is_measured_against_the_text_as_it_is(spark):
    said = spark.createDataFrame([(1, 1, "a" * 12)], "recording_id long, utterance_id long, text string")
    edits = spark.createDataFrame([(1, 0, n, "a" * k) for n, k in enumerate((24, 36, 60, 36))], "recording_id long, line int, nth int, new_text string")
    # 12 more each time is just allowed; 60 is not; the same text again changes nothing
    row = prompts.correct_names(said, edits).first()
    assert (len(row["text"]), row["edited"]) == (36, True)


def test_a_prompt_is_asked_once(spark, tmp_path):
    folder, store = tmp_path / "asked", str(tmp_path / "store")
    folder.mkdir()
    rows = spark.createDataFrame([(i, f"prompt {i % 7}") for i in range(40)] + [(99, None)], "id long, prompt string").repartition(6)
    ask = lambda name: {r["id"]: r["answer"] for r in prompts.stored_answers(rows, "prompt", "answer", counting(folder), name, store).collect()}
    first = ask("m1")
    assert asked(folder) == {f"prompt {i}": 1 for i in range(7)} and first[99] is None
    # equal prompts have one answer, though the model never answers alike; another run reads it
    assert all(first[i] == first[i % 7] for i in range(40)) and ask("m1") == first and sum(asked(folder).values()) == 7
    again = ask("m2")
    assert sum(asked(folder).values()) == 14 and not set(again.values()) & set(first.values()) - {None}


def test_rounds_ask_for_each_part_once(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    line = lambda i: f"{i:04} " + "word " * 18 + "\n"
    long_ = "".join(line(i) for i in range(900))
    df = spark.createDataFrame([(1, long_), (2, "short"), (3, "".join(line(i) for i in range(5000, 5030)))], "recording_id long, transcript string")
    out = prompts.condense(df, counting(folder), 2000, str(tmp_path / "store"), "m")
    got = {r["recording_id"]: r["transcript"] for r in out.collect()}
    assert got[2] == "short" and all(len(t) <= 2000 for t in got.values()) and got[3].startswith("5000")
    assert set(asked(folder).values()) == {1}
    # evaluated again, nothing is asked again and nothing differs
    n = sum(asked(folder).values())
    assert {r["recording_id"]: r["transcript"] for r in out.collect()} == got and sum(asked(folder).values()) == n


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abAB.\\E (", max_size=12), st.text("abB.\\E (", max_size=3)), min_size=1, max_size=30))
def test_marked_parts(spark, pairs):
    def plain(text, part):
        find, out, at = part.strip().lower(), [], 0
        while find and (i := text.lower().find(find, at)) >= 0:
            out += [(text[at:i], False), (text[i : i + len(find)], True)]
            at = i + len(find)
        return [p for p in [*out, (text[at:], False)] if p[0]]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, text string, part string")
    got = {r["i"]: [tuple(p) for p in r["m"]] for r in df.select("i", X.marked_parts(F.col("text"), F.col("part")).alias("m")).collect()}
    assert got == {i: plain(*p) for i, p in enumerate(pairs)}


def test_versions(spark):
    cases = [("1.2.3", "1.2.3", True), ("1.10", "1.9.9", True), ("1.2", "1.2.0", True), ("1.2", "1.2.1", False), ("2", "10", False), ("1.2-beta", "1.2", True), ("x", "0.0.1", False), ("", "0", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(X.version_at_least(F.col("a"), F.col("b")) != F.col("want")).collect() == []
