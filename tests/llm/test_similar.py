import numpy as np

from colloquy.llm import similar as S


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def plain(rows, similarity=0.8, width=5):
    """Smallest id of each document's component over all pairs of texts; ids must differ."""
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return {k: least[top(i)] for i, (k, _) in enumerate(rows)}


def made(rng):
    """Texts with near copies at all kinds of similarity, short ones, and a large group."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    texts = []
    for n in (1, 5, 6, 12, 40, 150, 400):
        for _ in range(2):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in (1, 2, max(1, n // 60), max(1, n // 40), max(1, n // 20), n // 4):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.integers(0, n)] = word()
                texts.append(copy)
    base = [word() for _ in range(150)]
    for k in range(25):
        copy = list(base)
        copy[rng.integers(0, 150)] = word()
        texts.append(copy + [word()] * (k % 3))
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_components_against_all_pairs(spark, monkeypatch):
    # lists and stars are cut into lots, common shingles are few texts' already
    monkeypatch.setattr(S, "LOT", 3)
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "COLUMNS", 50)
    monkeypatch.setattr(S, "COMMON", 5)
    rng = np.random.default_rng(7)
    rows = made(rng)
    # a passage that many texts share, in which they are alike but not near copies; texts that end at the threshold
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    passage = [word() for _ in range(60)]
    rows += [(2000 + i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(i % 5)])) for i in range(40)]
    base = [word() for _ in range(104)]
    rows += [(3000 + i, " ".join(base[: 104 - i])) for i in range(45)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[40][1].upper()), (9004, rows[40][1].replace(" ", " \t"))]
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, node int, digest string, size int")
    near = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df).collect()}
    want = plain(rows)
    assert len(set(want.values())) < 0.9 * len(rows)
    assert near == want
    # SimHash changes the work alone
    assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df, radius=0).collect()} == want


def test_other_similarity_and_width(spark):
    rows = made(np.random.default_rng(11))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df, similarity=0.6, shingle_words=3).collect()}
    assert near == plain(rows, 0.6, 3)


def test_shingle_hashes():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcç𝄞"), rng.integers(1, 5))) for _ in range(70_000)]
    raw = " ".join(words).encode()
    own = S.shingles(raw)
    texts = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    assert len(own) == len(texts) and len(set(own.tolist())) == len(set(texts))
    by_text = dict(zip(texts, own.tolist()))
    assert all(by_text[t] == h for t, h in zip(texts, own.tolist()))
    # the same wherever it stands
    assert int(S.shingles(" ".join(words[40_000:40_005]).encode())[0]) == int(own[40_000])
    assert len(S.shingles(b"")) == len(S.shingles(b"one two")) == 1


def test_prefixes_meet():
    """Sets of such a similarity share one of their first shingles, whatever the order."""
    rng = np.random.default_rng(2)
    for _ in range(3000):
        n, m = rng.integers(1, 30, 2)
        a, b = set(rng.integers(0, 35, n).tolist()), set(rng.integers(0, 35, m).tolist())
        if len(a & b) >= 0.8 * len(a | b):
            first = lambda s: set(sorted(s)[: S.prefix_length(len(s), 0.8)])
            assert first(a) & first(b)


def test_python_and_columns_make_one_digest(spark):
    texts = ["A  b\tC", None, "", "\u00c9t\u00e9 \n x\x1cy", " lead trail \x0b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["digest"]) for r in S.near_duplicates(df).collect()}
    assert got == {r["doc_id"]: bytes(r["d"]) for r in df.select("doc_id", S.words_digest(df.text).alias("d")).collect()}


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a B c"), (4, "a b c"), (None, "q")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in S.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "4"), ("None", "None")]
    assert S.near_duplicates(df.limit(0)).collect() == []


def test_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (1, 5, 80, 200, 0, 33)]
    got = S.common_shingles(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
