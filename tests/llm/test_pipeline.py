import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from test_mixing import plain_targets
from test_similar import plain

from colloquy.llm.mixing import BLOCK_WORDS


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stages_in_turn(spark, sf):
    """Every stage against a plain version of it."""
    sf_dir = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    good = P.quality(spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].index
    assert good.columns == docs.columns and len(set(clean) & kept) / len(clean) > 0.97
    bad = labels[(labels.toxic == 1) | (labels.quality == 0)].index
    assert len(set(bad) & kept) / len(bad) < 0.05
    assert not set(labels[labels.toxic == 1].index) & kept

    exact = P.exact_dedup(spark, good, sf_dir).cache()
    first = {}
    for r in good.collect():
        key = re.sub("[ \t-\r]+", " ", r["text"])
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert exact.columns == docs.columns and sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values())

    near = P.near_dedup(spark, exact, sf_dir).cache()
    want = plain([(r["doc_id"], r["text"]) for r in exact.collect()])
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(set(want.values()))

    mixed = P.mix(spark, near, sf_dir).cache()
    text, source = {r["doc_id"]: r["text"] for r in near.collect()}, {r["doc_id"]: r["source"] for r in near.collect()}
    size, taken, times = Counter(), Counter(), defaultdict(Counter)
    for i, t in text.items():
        size[source[i]] += len(t.split())
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"]) and r["source"] == source[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
        times[r["doc_id"]].update(r["text"].split())
    for i, words in times.items():  # three passes at most, over the words of the document
        own = Counter(text[i].split())
        assert all(n <= 3 * own[w] for w, n in words.items())
    order = sorted(size)
    for s, goal in zip(order, plain_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])):
        assert abs(taken[s] - goal) <= 3 * BLOCK_WORDS

    packed = P.pack_bins(spark, mixed, sf_dir).toPandas()
    assert packed.n_words.sum() == sum(len(r["text"].split()) for r in mixed.collect())
    filled = packed.dropna(subset=["bin_id"])
    assert not filled.duplicated(["bin_id", "doc_id"]).any() and filled.groupby("bin_id").n_words.sum().max() <= 8192
    for _, one in filled.sort_values("bin_offset").groupby("bin_id"):
        assert (one.bin_offset == one.n_words.cumsum() - one.n_words).all() and (one.bin_words == one.n_words.sum()).all()


def test_hard_rows(spark, sf_dir):
    rows = [(1, "a b c d", None, "s", None), (1, "a b c d", "en", "s", 7), (1, "e f", None, None, 3), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 30_000, "en", "t", 1), (4, "w " * 30_000, "en", "t", 1)]
    names = ["row", "digest", "id", "size", "key", "pieces", "taken", "nth", "_size", "kept", "bin_id"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    extra = {tuple(r[n] for n in names) for r in docs.collect()}
    assert P.quality(spark, docs, sf_dir).columns == docs.columns
    exact = P.exact_dedup(spark, docs, sf_dir)
    assert sorted(map(str, (r["doc_id"] for r in exact.collect()))) == ["1", "1", "2", "3"]
    near = P.near_dedup(spark, docs, sf_dir)
    assert sorted(map(str, (r["doc_id"] for r in near.collect()))) == ["1", "1", "1", "2", "3", "None", "None"]
    mixed = P.mix(spark, docs, sf_dir)
    assert mixed.count() > 0
    for out in (exact, near, mixed):
        assert out.columns == docs.columns and {tuple(r[n] for n in names) for r in out.collect()} == extra
    assert P.pack_bins(spark, docs, sf_dir).count() == 8 + 2 * 3
    for stage in (P.quality, P.exact_dedup, P.near_dedup, P.mix):
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert P.pack_bins(spark, docs.limit(0), sf_dir).collect() == []


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
