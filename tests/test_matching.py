"""Voices against enrolled speakers in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd

from colloquy.operators.speakers import _best_of


def test_a_block_holds_few_similarities_at_once():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3000, 8)), rng.normal(size=(6000, 8))
    b[4000] = b[17]
    a[5], a[6] = 2 * b[17], 0
    voices, known = pd.DataFrame({"voice_id": range(3000), "embedding": list(a)}), pd.DataFrame({"speaker_id": range(6000), "embedding": list(b)})
    tracemalloc.start()
    got = _best_of(voices, known).set_index("voice_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = np.round(np.divide(a @ b.T, np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1), out=np.zeros((3000, 6000)), where=np.linalg.norm(a, axis=1)[:, None] > 0), 6)
    assert got["speaker_id"].tolist() == near.argmax(axis=1).tolist() and np.allclose(got["similarity"], near.max(axis=1))
    assert got.loc[5, "speaker_id"] == 17 and got.loc[6, "similarity"] == 0
    # all 18,000,000 similarities would take 144 MB, and as much for each step on the way
    assert peak < 120 << 20
