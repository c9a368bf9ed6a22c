import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions.english import english_lexemes, english_tokens, stem, stemmed
from colloquy.operators import search, text_index
from colloquy.operators.text_index import TextIndex, bucket_of
from colloquy.operators.vector_index import VectorIndex, train_centroids
from colloquy.plans.fixtures import view
from colloquy.sources.files import names_in, write_text

# words and their stems by the published description of the later English algorithm
STEMS = """consigned consign consistency consist consolatory consolatori consolingly consol conspicuously conspicu conspiracy conspiraci conspirators conspir constancy constanc knackeries knackeri kneeling kneel
knives knive knocker knocker caresses caress ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri generously generous generation generat communism communism arsenal arsenal
by by say say cry cri happily happili relational relat conditional condit rationalize ration nationally nation dying die news news innings inning proceed proceed agreed agre feed feed bed bed youth youth
fluently fluentli beautifully beauti hopefulness hope analogies analog sensibility sensibl electrical electr goodness good adjustment adjust adoption adopt controlling control rate rate cease ceas skis ski skies sky
only onli exceeding exceed yelling yell toy's toy vietnamization vietnam""".split()


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert stem("straße") == "straße" and stem("as") == "as" and stemmed("The Things, and the thing!") == ["thing"]


def scope_of(spark, rows):
    chunks = spark.createDataFrame(rows, "chunk_id long, recording_id long, start_ms long, end_ms long, text string, embedding array<float>")
    recordings = chunks.select("recording_id").distinct().withColumn("title", F.lit("t")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return search.scoped(chunks, recordings, spark.createDataFrame([], "recording_id long, speaker_id long"))


def hits(df):
    return sorted((r["chunk_id"], r["score"]) for r in df.collect())


def test_text_index_follows_changes(spark, tmp_path):
    rng = np.random.default_rng(3)
    word = lambda: str(rng.choice(["and", "that", "x", "über", "y2", "thing"]))
    texts = {i: " ".join(word() for _ in range(int(rng.integers(0, 25)))) for i in range(60)} | {90: None, 91: "", 92: "and " * 3000 + "that"}
    rows = lambda t: [(i, i % 7, 0, 1, x, None) for i, x in t.items()]
    frame = lambda t: spark.createDataFrame(list(t.items()), "chunk_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/index", buckets=8)
    with pytest.raises(ValueError):
        index.postings()

    def same(now):
        scope = scope_of(spark, rows(now))
        for q in ("and that", "THAT", "thing über x", "and absent", "", "..."):
            assert hits(index.search(scope, q, 200)) == hits(search.keyword_search(scope, q, 200))

    index.put(frame(texts))
    same(texts)
    # changed, new and removed chunks; one that is removed and comes again
    change = {3: "that and that", 4: None, 100: "and that thing", 5: "nothing"}
    index.put(frame(change), removed=spark.createDataFrame([(7,), (8,), (12345,)], "chunk_id long"))
    now = {i: x for i, x in (texts | change).items() if i not in (7, 8)}
    same(now)
    index.put(frame({7: "and that"}))
    now[7] = "and that"
    same(now)
    # a layer without a marker is not seen
    index._write(9, index._postings(frame({3: "and that"})), None)
    same(now)
    assert index.layers() == [0, 1, 2]
    index.compact()
    assert index.layers() == [3] and names_in(spark, f"{tmp_path}/index/postings") == ["layer=3", "layer=9"]
    same(now)
    index.put(frame({3: "gone"}))
    same(now | {3: "gone"})


def test_text_index_reads_its_lexemes_folders_alone(spark, sf_dir, tmp_path):
    chunks = view(spark, sf_dir, "chunks_v")
    index = TextIndex(spark, f"{tmp_path}/index")
    index.put(chunks)
    read = index.postings(["and", "that"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in spark.createDataFrame([("and",), ("that",)], "t string").select(bucket_of(F.col("t"))).collect()}
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= buckets and len(buckets) < len(names_in(spark, f"{tmp_path}/index/postings/layer=0")) / 4
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1]
    assert "text" not in read.columns and "documents" not in plan
    # a lexeme's places, in order
    row = read.where("lexeme = 'and'").orderBy("chunk_id").first()
    assert row["positions"] == sorted(row["positions"])
    english = TextIndex(spark, f"{tmp_path}/english", analyzer=english_lexemes)
    english.put(chunks)
    assert english.postings().where("lexeme = ''").isEmpty()


def vectors(rng, n, dim=32, groups=40):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.6


@pytest.mark.parametrize("share", [1.0, 0.01])
def test_vector_index_recall(spark, tmp_path, share):
    """Recall against the exact search, without a filter and under one that lets a hundredth through."""
    rng = np.random.default_rng(5)
    x = vectors(rng, 20_000)
    rows = [(i, i // 20, 0, 1, "", None if i % 50 == 49 else [float(v) for v in y]) for i, y in enumerate(x)]
    scope = scope_of(spark, rows)
    index = VectorIndex.build(scope.chunks, f"{tmp_path}/cells", cells=64)
    kept = search.Scope(scope.chunks.where(F.pmod(F.xxhash64("recording_id"), F.lit(100)) < int(100 * share)).cache(), scope.recordings)
    found = total = 0
    for q in range(0, 20_000, 4000):
        want, got = hits(search.semantic_search(kept, rows[q][5], 20)), hits(index.search(kept, rows[q][5], 20))
        assert len(got) == len(want) == 20 and all(dict(want).get(i, s) == s for i, s in got)
        found, total = found + len({i for i, _ in got} & {i for i, _ in want}), total + 20
    assert found >= 0.9 * total
    cells = index.candidates(kept, rows[0][5], 20)[1]
    # a filter makes the search go on; without one a part of the cells does
    assert cells < 32 if share == 1.0 else cells > 16


def test_vector_index_recall_on_the_tables(spark, tmp_path):
    chunks, recordings = view(spark, "/root/testdata/sf0.1", "chunks_v").select("chunk_id", "recording_id", "start_ms", "end_ms", "embedding").cache(), view(spark, "/root/testdata/sf0.1", "recordings_v")
    index = VectorIndex.build(chunks, f"{tmp_path}/cells", cells=16)
    none = spark.createDataFrame([], "recording_id long, speaker_id long")
    for filters in (search.Filters(), search.Filters(since="1998-01-01", until="1998-01-31")):
        scope = search.scoped(chunks, recordings, none, filters)
        found = total = 0
        for q in (7, 100, 1500):
            vector = chunks.where(F.col("chunk_id") == q).first()["embedding"]
            want, got = {i for i, _ in hits(search.semantic_search(scope, vector))}, {i for i, _ in hits(index.search(scope, vector))}
            found, total = found + len(want & got), total + len(want)
        assert found >= 0.9 * total


def test_vector_index_changes_and_hard_rows(spark, tmp_path):
    rows = [(i, i, 0, 1, "", [float(np.cos(i)), float(np.sin(i))]) for i in range(50)] + [(90, 90, 0, 1, "", None), (91, 91, 0, 1, "", [0.0, 0.0])]
    scope = scope_of(spark, rows)
    VectorIndex.build(scope.chunks, f"{tmp_path}/cells", cells=5)
    index = VectorIndex.open(spark, f"{tmp_path}/cells")
    assert hits(index.search(scope, [1.0, 0.0], 5)) == hits(search.semantic_search(scope, [1.0, 0.0], 5))
    # one chunk has another vector, one is gone, one is new
    after = scope_of(spark, [r for r in rows if r[0] not in (0, 44)] + [(0, 0, 0, 1, "", [-1.0, 0.0]), (60, 60, 0, 1, "", [1.0, 0.0])])
    index.add(after.chunks.where("chunk_id IN (0, 60)"))
    for q in ([1.0, 0.0], [-1.0, 0.001]):
        assert hits(index.search(after, q, 5)) == hits(search.semantic_search(after, q, 5))
    assert index.search(search.Scope(after.chunks.limit(0), after.recordings), [1.0, 0.0]).collect() == []
    empty = scope_of(spark, [])
    assert VectorIndex.build(empty.chunks, f"{tmp_path}/none", cells=3).search(empty, [1.0, 0.0]).collect() == []


def test_vector_index_misses_no_row(spark, tmp_path):
    """One row of a tight cell lies far from its centroid and next to the query; copies and a vector that is not finite."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(i, i // 20, 0, 1, "", at(0 if i < 2000 else 90)) for i in range(4000)] + [(4000, 200, 0, 1, "", at(44)), (4001, 200, 0, 1, "", [float("nan"), 1.0])]
    scope = scope_of(spark, rows)
    index = VectorIndex.build(scope.chunks.where("chunk_id <> 4000"), f"{tmp_path}/cells", cells=2)
    index.add(scope.chunks.where("chunk_id = 4000"))
    got, want = ({i for i, _ in hits(rows)} for rows in (index.search(scope, at(60), 20), search.semantic_search(scope, at(60), 20)))
    assert want == {4001, 4000, *range(2000, 2018)}
    assert got == want


def test_centroids_are_units_and_none_is_lost():
    x = np.repeat(np.eye(4), 30, axis=0)
    c = train_centroids(x, 4)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and len(np.unique(np.round(c, 6), axis=0)) == 4


def test_small_files_are_whole(spark, tmp_path):
    write_text(spark, f"{tmp_path}/a/mark", "one")
    write_text(spark, f"{tmp_path}/a/mark", "two")
    assert [n for n in names_in(spark, f"{tmp_path}/a") if not n.startswith(".")] == ["mark"] and open(os.path.join(tmp_path, "a/mark")).read() == "two"
    assert names_in(spark, f"{tmp_path}/absent") == []


def test_places_of_a_chunk_are_found_in_its_own_row(spark, tmp_path):
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "the a the a"), (5, "x " * 3000)] + [(10 + i, "a " * (i % 3)) for i in range(450)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1)
    for analyzer, stop in ((lambda t: F.split(t, " "), ""), (english_lexemes, "the a")):
        got = TextIndex(spark, f"{tmp_path}/none", analyzer=analyzer)._postings(chunks)
        want = {}
        for i, text in rows:
            for pos, word in enumerate((text or "").split(" ")):
                if word and word not in stop.split():
                    want.setdefault((word, i), []).append(pos)
        assert sorted((r["lexeme"], r["chunk_id"], list(r["positions"])) for r in got.collect()) == sorted((*k, p) for k, p in want.items())
        # places are not grouped, so nothing moves before postings are dealt to their folders
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Aggregate" not in plan


def test_putting_texts_shuffles_no_postings_and_stores_few_bytes(spark, tmp_path):
    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text").coalesce(1)
    size = os.path.getsize("/root/testdata/sf0.01/documents.parquet")
    rows = []
    for i, options in enumerate(({}, {"analyzer": english_lexemes}, {"analyzer": english_lexemes, "cut": english_tokens})):
        before = shuffled()
        index = TextIndex(spark, f"{tmp_path}/{i}", buckets=4, **options)
        index.put(texts)
        index.put(texts.where("chunk_id % 3 = 0"))
        assert shuffled() - before < size / 20
        files = [os.path.join(at, f) for at, _, names in os.walk(f"{tmp_path}/{i}/postings") for f in names if f.endswith(".parquet")]
        assert sum(map(os.path.getsize, files)) < 1.5 * 4 / 3 * size
        rows.append(index.postings().select(F.count("*"), F.sum(F.xxhash64("lexeme", "chunk_id", "positions") % 1_000_003)).first())
    assert rows[1] == rows[2] != rows[0]


def test_blocks_hold_what_was_put_into_them(monkeypatch):
    """Ids at both ends of what a long holds, unordered; blocks of some chunks, one of them longer than a block may be."""
    ids = [5, -(2**63), 2**63 - 1, 0, -1, 300, 7, None]
    tokens = [["a", "b", "", "a"], ["b"] * 300 + ["a"], ["a", None, "c"], [], None, ["a"], ["", ""], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["chunk_id", "tokens"])
    want = sorted((x, i, [k for k, y in enumerate(t) if y == x]) for i, t in zip(ids, tokens) if t and i is not None for x in {*t} if x)
    rows = lambda blocks: sorted((r["lexeme"], r["chunk_id"], r["positions"]) for b in text_index._postings_of_blocks(blocks) for r in b.to_pylist())
    for places, size in ((10**6, 10**6), (1, 1), (3, 40), (10**6, 1)):
        monkeypatch.setattr(text_index, "PLACES", places)
        monkeypatch.setattr(text_index, "BYTES", size)
        blocks = list(text_index._blocks_of_tokens(iter([batch, batch.slice(0, 0)]), None))
        assert rows(iter(blocks)) == want
        assert rows(text_index._blocks_of_postings(text_index._postings_of_blocks(iter(blocks)))) == want
    assert len(blocks) == 1
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**63, 2**64 - 1], dtype=np.uint64)
    data, length = text_index._to_bytes(values)
    back, end = text_index._from_bytes(data)
    assert back.tolist() == values.tolist() and np.diff(end, prepend=0).tolist() == length.tolist()
    assert english_tokens(pa.array(["The Things, and the thing!", None, ""])).to_pylist() == [["", "thing", "", "", "thing"], [], []]
