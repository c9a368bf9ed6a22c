"""Tokens of one long text get their times in one pass over it."""

import time

from pyspark.sql import functions as F

from colloquy.operators import windows


def test_long_texts_are_cut_once(spark):
    n = 20_000
    rows = spark.createDataFrame([(1, "ab c " * (n // 2), 5, 30_005), (2, " ", 0, 9), (3, None, 0, 9), (4, "x", 7, 3), (5, "one two", 0, 5)], "id long, text string, a long, b long")
    began = time.time()
    got = {r["id"]: r["x"] for r in rows.select("id", windows.interpolated(F.col("text"), F.col("a"), F.col("b")).alias("x")).collect()}
    even = {r["id"]: r["x"] for r in rows.select("id", windows.spread_evenly(F.col("text"), F.col("b") - F.col("a")).alias("x")).collect()}
    took = time.time() - began
    upto = [3 * (k // 2) + 2 * (k % 2) for k in range(n + 1)]
    assert [(x["pos"], x["token"], x["start_ms"], x["end_ms"]) for x in got[1]] == [(k, "ab" if k % 2 == 0 else "c", 5 + int(30_000 * upto[k] / upto[n] + 0.5), 5 + int(30_000 * upto[k + 1] / upto[n] + 0.5)) for k in range(n)]
    assert got[2] == even[2] == [] and got[3] is even[3] is None and [tuple(x) for x in got[4]] == [(0, "x", 7, 7)] and [tuple(x) for x in got[5]] == [(0, "one", 0, 3), (1, "two", 3, 5)]
    assert len(even[1]) == n and tuple(even[1][n - 1]) == ("c", n - 1, 30_000) and [tuple(x) for x in even[5]] == [("one", 0, 2), ("two", 2, 5)]
    # cut again for each token it took minutes
    assert took < 30
