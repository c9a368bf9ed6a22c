from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from colloquy.llm import chat_format as C

PIECES = st.lists(st.sampled_from([C.START, C.END, "<", "|", "\\", "<|", "<\\|", "<\\\\|", "\n", "\\n", "\\l", "a", " ", "é", "im_end|>", "assistant"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 4), st.one_of(PIECES, st.sampled_from(["user", "assistant"])), PIECES), min_size=20, max_size=60))
def test_round_trip_of_hard_texts(spark, rows):
    got = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in got:
        want = sorted((t, r, x) for c, t, r, x in rows if c == conv["conv_id"])
        assert conv["round_trip"] and [tuple(t) for t in conv["turns"]] == [(r, x) for _, r, x in want]
        assert conv["formatted"] == "".join(s["text"] for s in conv["segments"])
        assert conv["formatted"].count(C.START) == conv["formatted"].count(C.END) == len(want)
        spans = [conv["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in conv["loss_spans"]]
        assert spans == [s["text"] for s in conv["segments"] if s["loss"]]


def test_nulls_ties_and_other_columns(spark):
    rows = [(1, None, "user", "late", "x"), (1, 0, None, None, "x"), (1, 0, "assistant", "b" * 100_000, "x"), (1, 0, "assistant", "b" * 100_000, "x"), (None, 0, "user", "", "x")]
    got = {r["conv_id"]: r for r in C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")).collect()}
    assert [t["role"] for t in got[1]["turns"]] == ["", "assistant", "assistant", "user"] and got[1]["round_trip"]
    assert len(got[None]["turns"]) == 1
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
