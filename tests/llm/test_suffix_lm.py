import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import suffix_lm as L
from colloquy.llm.store import save


def plain(rows, depth, p_min, divergence, smoothing=L.SMOOTHING):
    """Base and model scores from the definitions, with dictionaries."""
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in words]
    c, grams = Counter(), defaultdict(Counter)
    for (_, w), h in zip(words, held):
        if not h:
            c.update(w + [b""])
            text = b"\n" * depth + b" ".join(w) + b"\n"
            for t in range(depth, len(text)):
                for k in range(depth + 1):
                    grams[text[t - k : t]][text[t]] += 1
    n, v = sum(c.values()), len(c)
    total = sum(grams[b""].values())
    sums = {s: sum(d.values()) for s, d in grams.items()}
    kept = {b""}
    for s in grams:
        if s and sums[s] >= p_min * total and (len(s) == 1 or sum(x / sums[s] * math.log((x / sums[s]) / (grams[s[1:]][y] / sums[s[1:]])) for y, x in grams[s].items()) >= divergence):
            kept |= {s[j:] for j in range(len(s) + 1)}

    def p(s, y):
        if not s:
            return (grams[b""][y] + 1) / (total + 256)
        weight = smoothing * len(grams[s])
        return (grams[s][y] + weight * p(s[1:], y)) / (sums[s] + weight)

    out = []
    for (i, w), h in zip(words, held):
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w + [b""])
        text, score = b"\n" * depth + b" ".join(w) + b"\n", 0.0
        for t in range(depth, len(text)):
            s = next(text[t - k : t] for k in range(depth, -1, -1) if text[t - k : t] in kept)
            score += math.log10(p(s, text[t]))
        out.append((i, h, len(w) + 1, sum(x in c for x in w + [b""]), n, base, score))
    return out


@pytest.mark.parametrize("frequent", [L.FREQUENT, 0.01])
def test_against_the_definitions(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    rows = [(r["doc_id"], r["text"][:1500]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows += [(9001, None), (9002, ""), (None, "Zzz qqq"), (9003, " \t A  b "), (9003, "x" * 9000), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, token int")
    got = sorted(map(tuple, L.score_texts(df, depth=3, p_min=0.002).collect()), key=str)
    want = sorted(plain(rows, 3, 0.002, L.DIVERGENCE), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5, atol=1e-4)


def test_without_training_rows_and_empty(spark):
    got = L.score_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), is_held_out=L.F.lit(True)).collect()[0]
    assert got["n_tokens"] == 2 and got["n_known"] == got["train_tokens"] == 0
    assert abs(got["base_score"]) < 1e-12 and abs(got["score"] - 2 * math.log10(1 / 256)) < 1e-4
    assert L.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_text_is_likelier_than_under_the_base(spark, sf):
    scored = L.score_texts(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert scored["sum(score)"] > scored["sum(base_score)"]


def against_plain(spark, rows, depth, share, **how):
    got = sorted(map(tuple, L.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, **how).collect()), key=str)
    want = sorted(plain(rows, depth, share, L.DIVERGENCE), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-5, atol=1e-4)


def test_rare_contexts_of_a_long_text_are_kept(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(L, "CELL_TOKENS", 5_000)
    rng = np.random.default_rng(3)
    rows = [(i, "ab " * 4000 + " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(40))) for i in range(32)]
    n = 32 * 12_200
    # a share below 1e-5, and a count that is less than 1e-5 of the positions
    against_plain(spark, rows, 4, 1e-7, p_min=1e-7)
    against_plain(spark, rows, 4, 1.5 / n, min_count=2)


def test_the_defaults_are_six_bytes_and_a_count(spark):
    rows = [(i, f"the {'cat' if i % 3 else 'dog'} sat on mat {i % 5} again") for i in range(300)]
    total = sum(len(t) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    against_plain(spark, rows, L.DEPTH, (L.MIN_COUNT - 0.5) / total)
    assert L.DEPTH == 6


def test_scoring_a_block_holds_no_places_of_its_bytes(monkeypatch):
    monkeypatch.setattr(L, "SLICE_BYTES", 1 << 16)
    block, texts = L.Block(L.DEPTH), [b"the cat sat on mat %d again" % (i % 50) for i in range(150_000)]
    for words in L._slices(iter(texts)):
        block.add(words, np.ones(len(words), dtype=bool))
    s = block.saved()
    listed = list(L._listed(s["texts"], s["sizes"], s["learns"], L.DEPTH, 4))
    # grams of one text have one logarithm each, so a score is their number
    logs = pa.table({"cell": [c for c, _, _ in listed], "n": [len(x) for _, x, _ in listed], "logs": [L._packed(np.full(len(x), -1, dtype=np.float32)) for _, x, _ in listed]})
    row = pa.table({"block": [1], "texts": pa.array([s["texts"]], pa.list_(pa.binary())), "sizes": [s["sizes"]]})
    tracemalloc.start()
    got = L._scored(row, logs, L.DEPTH, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["score"].to_pylist() == [-(len(t) + 1.0) for t in texts]
    # the places of all bytes alone would take four times the block
    assert peak < 4 * block.size, peak / block.size


def test_codes_are_the_bytes_before_from_the_last_one_on():
    flat = np.random.default_rng(1).integers(0, 256, 40).astype(np.uint8)
    for depth in (2, 5, 6):
        want = [int.from_bytes(bytes(flat[t - depth : t][::-1]) + bytes(flat[t : t + 1])) for t in range(depth, 40)]
        assert L._codes(flat, depth).tolist() == want


def test_ranges_are_merged_one_at_a_time(monkeypatch):
    monkeypatch.setattr(L, "HELD_GRAMS", 50_000)
    rng = np.random.default_rng(5)
    slices = [np.sort(rng.choice(1 << 20, 40_000, replace=False)) for _ in range(60)]
    slices.insert(0, np.zeros(0, dtype=np.int64))
    counted, alone = L.Ranges(), L.Ranges()
    for codes in slices:
        counted.add(codes, np.ones(len(codes), dtype=np.uint32))
        alone.add(codes)
    codes, counts = (np.concatenate(x) for x in zip(*counted.taken()))
    assert np.array_equal(np.concatenate(list(alone.taken())), codes)
    want, times = np.unique(np.concatenate(slices), return_counts=True)
    assert np.array_equal(codes, want) and np.array_equal(counts, times)
    assert not any(counted.parts)


def test_listing_a_block_holds_its_grams_once():
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(1000)]
    block = L.Block(L.DEPTH)
    for words in L._slices(iter(texts)):
        block.add(words, np.arange(len(words)) % 7 != 2)
    s = block.saved()
    tracemalloc.start()
    n = sum(len(codes) for _, codes, _ in L._listed(s["texts"], s["sizes"], s["learns"], L.DEPTH, 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 3_900_000
    # a gram's code and count take 12 bytes
    assert peak < 36 * n, peak / n


def test_blocks_lie_in_small_pages_that_no_buffer_holds_whole(spark, monkeypatch):
    """Executors keep the buffers of Parquet's default codec, which are as large as the largest page they met."""
    saved = {}

    def spied(df, name, **options):
        saved[name] = save(df, name, **options)
        return saved[name]

    def chunks(table):
        jvm = spark._jvm
        for file in table.inputFiles():
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
            for group in reader.getFooter().getBlocks():
                for chunk in group.getColumns():
                    yield chunk.getCodec().toString(), chunk.getTotalUncompressedSize() / reader.readOffsetIndex(chunk).getPageCount()
            reader.close()

    monkeypatch.setattr(L, "save", spied)
    L.score_texts(spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")).collect()
    assert {codec for codec, _ in chunks(saved["blocks"])} == {"ZSTD"}
    # forty rows of 300 kB each are a page of 12 MB where only every hundredth row is looked at
    rows = spark.range(0, 40, 1, 1).select(F.expr("cast(repeat(uuid(), 8500) as binary)").alias("x"))
    assert max(size for _, size in chunks(save(rows, "narrow"))) > 8e6
    assert max(size for _, size in chunks(save(rows, "wide", wide=True))) < 2e6
