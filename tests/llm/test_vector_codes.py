import hashlib
import math

import numpy as np

from colloquy.llm import vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest of rows (vec_id, vector, label); Python integers, no bounds."""
    out = []
    good = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n in sorted({len(v) for _, v, _ in good}):
        own = sorted((r for r in good if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        edge = [p * n // parts for p in range(parts + 1)]
        cut = [[[max(-V.MOST, min(V.MOST, math.floor(256 * x))) for x in v[a:b]] for a, b in zip(edge, edge[1:])] for _, v, _ in own]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]
        dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        for turn in range(rounds + 1):
            code = [[min(range(len(books[p])), key=lambda k: (dist(c[p], books[p][k]), k)) for p in range(parts)] for c in cut]
            if turn == rounds:
                break
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [c[p] for c, z in zip(cut, code) if z[p] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for (i, _, label), c, z in zip(own, cut, code):
            out.append((i, "".join(f"{k:02x}" for k in z), sum(dist(c[p], books[p][z[p]]) for p in range(parts)), label, digest))
    total = {}
    for _, _, error, label, _ in out:
        total[label] = total.get(label, 0) + error
    return sorted(((i, c, e, total[label], d) for i, c, e, label, d in out), key=str)


def found(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, v, l, 0, "a", 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, error int, code string, n int")
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in V.op11_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_against_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(4)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i), f32(rng.normal(size=32) * 0.2), int(rng.integers(0, 3))) for i in rng.permutation(260)]
    # coarse values, so that distances are often equal
    rows += [(1000 + i, f32(rng.integers(-1, 2, 32) / 256), None if i % 3 else 7) for i in range(120)]
    rows += [(2000, f32([0.1] * 32), 1)] * 40 + [(None, f32([0.1] * 32), 1), (None, f32([-0.1] * 32), None), (3, f32([0.2] * 32), 1)]
    rows += [(5000, None, 1), (5001, f32([0.1] * 31) + [None], 1), (5002, f32([0.1] * 31) + [float("nan")], 1), (5003, f32([0.1] * 31) + [float("-inf")], 1)]
    # other lengths, one without components, huge components
    rows += [(6000 + i, f32(rng.normal(size=20)), 9) for i in range(70)] + [(7000, [], 9), (7001, [1.0], None), (7002, [1e30, -1e30, 3e-45], 2), (7003, [-0.0, 1.0, 2.0], 2)]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_few_rows_and_none(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert found(spark, [(1, None, 1)], tmp_path) == []
    rows = [(4, [0.5] * 16, None), (2, [0.25] * 16, None), (9, [0.25] * 16, 1)]
    assert found(spark, rows, tmp_path) == plain(rows)


def test_bounds_spare_scans_and_change_nothing(spark):
    rng = np.random.default_rng(8)
    # far-apart centres: most parts keep their entry
    centres = rng.integers(-2000, 2000, (64, 16)) / 256
    at = np.r_[np.arange(64), rng.integers(0, 64, 3000)]
    x = centres[at] + rng.normal(size=(len(at), 16)) * 0.02
    rows = [(i, [float(np.float32(y)) for y in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    state, books = V.vector_codes(df, parts=4, rounds=3)
    got = {r["vec_id"]: (bytes(r["code"]), r["error"], r["scanned"]) for r in state.collect()}
    want = {i: (c, e) for i, c, e, _, d in plain(rows, parts=4, rounds=3)}
    assert {i: (c.hex(), e) for i, (c, e, _) in got.items()} == want
    assert sum(n for _, _, n in got.values()) < 0.5 * 4 * len(rows)


def test_bounds_hold_at_every_round():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 1 << 26):
        x, entries = rng.integers(-scale, scale + 1, (500, 4)), rng.integers(-scale, scale + 1, (9, 4))
        code, upper, lower = V.assigned(x, entries)
        for _ in range(6):
            moved = entries + rng.integers(-1 - scale // 50, 2 + scale // 50, entries.shape) * (rng.random((9, 1)) < 0.6)
            code, upper, lower, scanned = V.reassigned(x, code, upper, lower, entries, moved)
            near = ((x[:, None, :].astype(object) - moved[None]) ** 2).sum(axis=2)
            assert [int(k) for k in code] == [min(range(9), key=lambda k: (row[k], k)) for row in near]
            for row, k, u, l in zip(near, code, upper, lower):
                assert float(u) >= math.sqrt(row[k]) and float(l) <= math.sqrt(min(v for j, v in enumerate(row) if j != k))
            entries = moved
