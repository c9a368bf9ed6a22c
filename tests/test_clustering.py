import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from colloquy.operators import speakers as S


def scanned(vectors, expected=None):
    """Average linkage by looking at all pairs for every merge."""
    x = S._unit(vectors)
    near, groups, accepted = x @ x.T, [[i] for i in range(len(x))], []
    while len(groups) > (min(expected, len(x)) if expected else 1):
        best, i, j = max(((np.round(near[np.ix_(a, b)].mean(), 12), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        i, j = -i, -j
        if not expected and len(groups) <= S.MOST_SPEAKERS and best < S.RELATIVE_DROP * (float(np.median(accepted)) if accepted else 1.0):
            break
        accepted.append(best)
        groups[i] += groups.pop(j)
    return [next(k for k, g in enumerate(groups) if f in g) for f in range(len(x))]


def planted(rng, n, speakers, dim=16, noise=0.25):
    centres = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:speakers]
    who = rng.integers(0, speakers, n)
    return centres[who] + rng.normal(size=(n, dim)) * noise, who


def first_seen(who):
    names = {}
    return [names.setdefault(w, len(names)) for w in who]


@pytest.mark.parametrize("expected", [None, 1, 3, 7, 500])
def test_chains_merge_what_scans_merge(expected):
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 60):
        for noise in (0.1, 0.4, 2.0):
            x = planted(rng, n, min(4, n), noise=noise)[0].tolist()
            assert S.cluster_voices(x, list(range(n)), expected) == scanned(x, expected)


def test_zero_and_equal_vectors():
    assert S.cluster_voices([[0.0, 0.0]] * 3, [0, 1, 2], 1) == [0, 0, 0]
    assert S.cluster_voices([[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 4, list(range(9))) == [0] * 5 + [1] * 4
    assert S.cluster_voices([[1.0, 0.0], None, [0.0, 1.0], []], [0, 49, 100, 51], 2) == [0, 0, 1, 1]


def test_twenty_thousand_fragments():
    x, who = planted(np.random.default_rng(2), 20_000, 5, dim=8, noise=0.05)
    began = time.time()
    assert S.cluster_voices(list(x), list(range(20_000))) == first_seen(who)
    assert time.time() - began < 240


def test_long_recordings_by_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for rec, (n, k, noise, stated) in enumerate([(300, 4, 0.2, None), (260, 3, 0.3, 3), (40, 2, 0.2, None), (220, 6, 1.0, 5), (1, 1, 0.1, None)]):
        x, _ = planted(rng, n, k, noise=noise)
        vectors = [None if i % 13 == 5 else v.tolist() for i, v in enumerate(x)]
        mids = [i * 10 for i in range(n)]
        want |= {(rec, i): c for i, c in enumerate(S.cluster_voices(vectors, mids, stated))}
        rows += [(rec, i, mids[i], vectors[i], stated) for i in range(n)]
    rows += [(9, i, i, None, None) for i in range(45)]
    want |= {(9, i): 0 for i in range(45)}
    df = spark.createDataFrame(rows, "recording_id long, fragment_no long, mid_ms long, embedding array<double>, stated int")
    for largest in (40, 100_000):
        got = {(r["recording_id"], r["fragment_no"]): r["cluster"] for r in S.cluster_fragments(df, "stated", largest, str(tmp_path / str(largest))).collect()}
        assert got == want


def test_two_blocks_of_clusters_meet_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(3000, 4)).round(1), rng.integers(1, 5, 3000)
    left = pd.DataFrame({"recording_id": 1, "slot": np.arange(3000), "v": list(x), "n": n})
    right = pd.DataFrame({"other": np.arange(3000), "w": list(x), "m": n}).sample(frac=1, random_state=1)
    near = np.round((x @ x.T) / (n[:, None] * n), 12)
    np.fill_diagonal(near, -np.inf)
    tracemalloc.start()
    got = S._nearest_clusters(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["slot"].tolist() == list(range(3000)) and got["other"].tolist() == near.argmax(axis=1).tolist() and got["similarity"].tolist() == near.max(axis=1).tolist()
    # all similarities at once are 72 MB
    assert peak < 60e6, peak
    monkeypatch.setattr(S, "CELLS", 1)
    assert S._nearest_clusters(left[:9], right).equals(got[:9])
    assert S._nearest_clusters(left[:1], right[right["other"] == 0]).empty
