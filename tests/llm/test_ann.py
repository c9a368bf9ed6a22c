import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import ann as A


def brute(rows, k, every):
    """The exact answer, vector by vector."""
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.asarray(v, dtype=float)
    out = {}
    for q in good:
        if q % every == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(good[q], good[c])), c) for c in good if c != q)
            out[q] = [(n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, ids, x, every, k=20):
    """Share of the true neighbours found; every query must have k rows, with exact scores in order."""
    at, hit, queries = {i: n for n, i in enumerate(ids.tolist())}, 0, ids[ids % every == 0].tolist()
    for q in queries:
        score = x @ x[at[q]]
        score[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:k]].tolist())
        assert [r for r, _, _ in got[q]] == list(range(1, k + 1)), q
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
        assert np.allclose([s for _, _, s in got[q]], [score[at[v]] for _, v, _ in got[q]], rtol=1e-12, atol=1e-12)
        hit += len(best & {v for _, v, _ in got[q]})
    return hit / (k * len(queries))


def table(spark, ids, x, kind="double"):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>")


def test_hard_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # many equal vectors
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, []), (None, [1.0] * 5), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, query string")
    got, want = found(A.nearest(df, F.col("id") % 10 == 0, k=6, probed=1.0)), brute(rows, 6, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], rtol=0, atol=1e-12)
    # with few probes there are as many rows, and each score is exact
    score = {(q, c): s for q, near in brute(rows, 10**6, 10).items() for _, c, s in near}
    few = found(A.nearest(df, F.col("id") % 10 == 0, k=6, probed=0.01))
    assert {q: len(near) for q, near in few.items()} == {q: 6 for q in want}
    assert all(abs(s - score[q, c]) < 1e-12 for q, near in few.items() for _, c, s in near)


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert found(A.nearest(df, F.col("id") % 20 == 0)) == {0: [(1, 1, 0.5)]}
    assert A.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_a_query_far_from_everything_goes_on(spark):
    rng = np.random.default_rng(4)
    x = np.ones(16) + rng.normal(0, 0.02, (1500, 16))
    x[0] = -1.0
    got = found(A.nearest(table(spark, np.arange(1500), x), F.col("id") == 0))
    assert len(got[0]) == 20


def test_scores_are_those_of_the_doubles(spark):
    x = np.random.default_rng(5).normal(size=(40, 8)) * (1 + 1e-9)
    got = found(A.nearest(table(spark, np.arange(40), x), F.col("id") == 0, probed=1.0))[0]
    for _, v, s in got:
        assert abs(s - float(x[0] @ x[v])) < 1e-14


@pytest.mark.parametrize("case", ["norms over six decades", "one long vector", "clusters"])
def test_recall_on_uneven_vectors(spark, case):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    if case == "norms over six decades":
        x *= 10 ** rng.uniform(-3, 3, (3000, 1))
    elif case == "one long vector":
        x[1] *= 1000
    else:
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    ids = np.arange(3000)
    assert recall(found(A.nearest(table(spark, ids, x), F.col("id") % 20 == 0)), ids, x, 20) >= 0.9


@pytest.mark.parametrize("sf,part_rows", [("sf0.001", 16_384), ("sf0.01", 16_384), ("sf0.1", 16_384), ("sf0.1", 300)])
def test_recall_against_brute_force(spark, monkeypatch, sf, part_rows):
    monkeypatch.setattr(A, "PART_ROWS", part_rows)
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    data = df.where(A.usable(F.col("embedding"))).toPandas().drop_duplicates("vec_id")
    ids, x = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(float)
    share = recall(found(A.nearest(df, F.col("id") % 20 == 0)), ids, x, 20)
    print(f"recall on {len(ids)} vectors of {sf}: {share:.4f}")
    assert share >= 0.9


def test_recall_on_fifty_thousand_vectors(spark, tmp_path):
    """Vectors as the tables have them, with many queries in each batch of a part."""
    rng = np.random.default_rng(12)
    n = 50_000
    centres = rng.normal(size=(10, 64))
    x = centres[rng.integers(0, 10, n)] * 0.35 + rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(n)
    spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    share = recall(found(A.nearest(df, F.col("id") % 50 == 0)), ids, x.astype(float), 50)
    print(f"recall on {n} vectors: {share:.4f}")
    assert share >= 0.9
