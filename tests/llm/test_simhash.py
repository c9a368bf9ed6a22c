import re

import numpy as np
import pytest
import xxhash

from colloquy.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    """Smallest row number reachable, by brute force over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(rows)
    fps = [plain_fingerprint(rows[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, plain_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op3_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("shard_rows,limit", [(40, 10_000), (40, 24), (100_000, 50), (100_000, 100_000)])
def test_links_are_exact_for_any_tree(spark, shard_rows, limit):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(12)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in S.components(S.links(df, 4, shard_rows, limit)).collect()}
    want = plain_components([x & (1 << 64) - 1 for x in fps])
    assert {x: got.get(x, x) for x in fps} == {x: fps[r] for x, r in zip(fps, want)}


def test_nulls_ties_and_clashing_columns(spark):
    long_text = "word " * 300_000
    rows = [(1, None, "x"), (2, "", "y"), (3, "A b c d e", None), (3, "a  B c d e", None), (None, "a b c d e", "z"), (None, None, "q"), (9, long_text, "l")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == 7
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    zero = 0
    assert by[(1, zero)] == by[(2, zero)] == by[(None, zero)] == 1
    assert sum(r["component_id"] == 3 for r in got) == 3
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
