import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.llm import exact_dedup as E


def plain(rows, digest):
    """(doc_id, keep_id, group_size, kept) by brute force."""
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    seen, out = set(), []
    for (i, _), n in zip(rows, norm):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and n not in seen
        if kept:
            seen.add(n)
        out.append((i, digest(n), keep, len(groups[n]), kept))
    return Counter(out)


ROWS = [(5, "a  b"), (2, "a\tb"), (2, "a b"), (9, None), (8, ""), (None, "z"), (None, "z"), (3, "one"), (None, "a b"), (1, "x" * 200_000), (4, "x" * 200_000), (6, " a b"), (7, "é")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "q", 1) for r in ROWS], "doc_id long, text string, digest string, n int")
    assert Counter(map(tuple, E.exact_duplicates(df).collect())) == plain(ROWS, sha)


def test_digest_collisions_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    weak = lambda text: F.substring(E.sha256_digest(text), 64, 1)
    assert Counter(map(tuple, E.exact_duplicates(df, weak).collect())) == plain(ROWS, lambda t: sha(t)[-1])


def test_runs_merge(spark):
    a = E.flush_runs(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string"))
    b = E.flush_runs(spark.createDataFrame([(3, "a")], "doc_id long, text string"))
    got = {r["digest"]: (r["keep_id"], r["n"]) for r in E.compact(a, b).collect()}
    assert got == {sha("a"): (3, 2), sha("b"): (6, 1)}


def test_empty_table(spark):
    assert E.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
