import random
from collections import Counter, defaultdict

from colloquy.llm import packing as P


def plain(sizes, sources, clusters, capacity, quota):
    """Tightest compatible bin by looking at all of them."""
    bins, placed = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and (c is None or c not in b["clusters"]) and b["sources"][s] < quota]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        bins[k]["left"] -= n
        bins[k]["clusters"].add(c)
        bins[k]["sources"][s] += 1
        placed.append(k)
    return placed


def test_against_looking_at_all_bins():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 80)
        sizes = sorted((rng.randrange(1, 50) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice("aab") for _ in range(n)], [rng.choice([None, 1, 2, 3, 4 + rng.randrange(90)]) for _ in range(n)]
        assert P.pack_pieces(sizes, sources, clusters, 60, 3) == plain(sizes, sources, clusters, 60, 3)


def test_table(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 3}", "x") for i in range(400)] + [(500, "z " * 1000, "s0", "x"), (501, None, None, "x"), (None, "a b", None, "x"), (None, "a b", None, "x")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string"), capacity=200, shard_pieces=150).collect()
    words = Counter()
    bins = defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["n_words"]
        if r["n_words"] == 0:
            assert r["bin_id"] is None
        else:
            bins[r["bin_id"]].append(r)
    want = Counter()
    for i, text, _, _ in rows:
        want[i] += len((text or "").split())
    assert words == want
    text_of, source_of = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    for parts in bins.values():
        parts.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in parts:
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at == parts[0]["bin_words"] <= 200
        copies = [text_of[r["doc_id"]] for r in parts]
        assert len(set(copies)) == len(copies)
        assert max(Counter(source_of[r["doc_id"]] for r in parts).values()) <= P.SOURCE_QUOTA
    assert [r["start_word"] for r in sorted(got, key=lambda r: (r["piece"])) if r["doc_id"] == 500] == [0, 200, 400, 600, 800]
    assert P.pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_large_ids_and_nulls_stay_what_they_are(spark):
    ids = [2**60 + 1, 2**60 + 2, None, -(2**62) - 1, None]
    df = spark.createDataFrame([(i, f"word{n}", None if n % 2 else "s") for n, i in enumerate(ids)], "doc_id long, text string, source string")
    for how in ({}, {"cluster": df["doc_id"]}):
        got = P.pack(df, **how).collect()
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in got)
        # ids that differ are different clusters, null ones conflict with nothing: all fit one bin
        assert len({r["bin_id"] for r in got}) == 1


def test_the_same_bins_in_any_layout(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).cache()
    docs = docs.unionByName(docs.limit(30)).unionByName(docs.limit(10)).cache()
    bins = lambda df: sorted(map(str, P.pack(df, shard_pieces=100).collect()))
    first = bins(docs)
    assert first == bins(docs.repartition(7)) and len(first) >= 440
    # equal rows listed in several lots give the same rows
    monkeypatch.setattr(P, "LOT", 2)
    assert first == bins(docs.coalesce(1))
