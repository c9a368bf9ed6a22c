from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import mixing as M


def plain_targets(sizes, weights, repeats=3):
    """Share by weight; cap those above ``repeats`` times their size and share the rest again."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / whole > repeats * sizes[i]}
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / whole
            break
        for i in over:
            target[i] = repeats * sizes[i]
        rest -= sum(target[i] for i in over)
        open_ -= over
    return target


def test_targets_stop_at_three_times_the_size(spark):
    rng = np.random.default_rng(1)
    for sizes, weights in (([1000, 10, 10, 500], [5, 2, 1, 5]), ([0, 0], [5, 2]), ([7], [5]), (rng.integers(0, 2000, 60).tolist(), [(5, 2, 1)[i % 3] for i in range(60)])):
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, source_size long, weight double")
        got = [r["target"] for r in M.with_targets(df).orderBy("i").collect()]
        assert np.allclose(got, plain_targets(sizes, weights), rtol=1e-12)
    assert M.with_targets(df.limit(0)).collect() == []


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (1, 99):
            image = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image.tolist()) == list(range(n))
    many = M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5))
    assert (many != M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 6))).mean() > 0.9


def test_running_sums(spark):
    rows = [(i % 7, i) for i in range(500)]
    got = M.running(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], {"n": F.lit(1), "s": F.col("b")}).collect()
    want, n, s = {}, 0, 0
    for a, b in sorted(rows):
        want[a, b] = (n, s)
        n, s = n + 1, s + b
    assert {(r["a"], r["b"]): (r["n"], r["s"]) for r in got} == want


def _docs(spark):
    rows = [(i, f"w{i} " * (50 + i % 300), f"s{i % 7}", 1) for i in range(350)]
    rows += [(900 + i, "v " * 40, "small", 2) for i in range(3)]
    rows += [(1000, None, "s0", 1), (1001, "", None, 1), (1002, "a b c", None, 1), (None, "d e", "s1", 1), (None, "d e", "s1", 1), (1003, "x " * 50_000, "s2", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def expected(layout, sources, seed):
    """What each row is given: draws, numbers of slots, permutations and cuts by hand."""
    slots, blocks = {s["source_no"]: s["slots"] for s in sources}, {s["source_no"]: s["blocks"] for s in sources}
    used = sorted(s for s, n in slots.items() if n)
    total = sum(slots.values())
    free, numbers, had = [], [], Counter()
    chunks = defaultdict(list)
    for s in used:
        chunks[s // M.CHUNK].append(s)
    heads = np.array([sum(slots[s] for s in chunks[c]) for c in sorted(chunks)], dtype=float)
    for shard in range(-(-total // M.SHARD_SLOTS)):
        n = np.random.default_rng([seed, shard]).multinomial(min(M.SHARD_SLOTS, total - shard * M.SHARD_SLOTS), heads / heads.sum())
        for c, k in zip(sorted(chunks), n):
            own = np.array([slots[s] for s in chunks[c]], dtype=float)
            for s, got in zip(chunks[c], np.random.default_rng([seed, shard, c + 1]).multinomial(k, own / own.sum())):
                for _ in range(got):
                    if had[s] < slots[s]:
                        numbers.append((s, had[s], shard))
                    else:
                        free.append((shard, s))
                    had[s] += 1
    short = [(s, j) for s in used for j in range(had[s], slots[s])]
    numbers += [(s, j, shard) for (s, j), (shard, _) in zip(short, sorted(free), strict=True)]
    assert len(set((s, j) for s, j, _ in numbers)) == total
    at = defaultdict(list)
    for s, j, shard in numbers:
        turn = j // blocks[s]
        block = int(M.permuted([j % blocks[s]], [blocks[s]], [(s * 8 + turn) * 65_537 + seed])[0])
        at[s, block].append((turn, shard))
    out = {}
    for r in layout:
        pieces = []
        for block in range(r["offset"] // M.BLOCK_WORDS, -(-(r["offset"] + r["size"]) // M.BLOCK_WORDS)):
            a, b = max(r["offset"], block * M.BLOCK_WORDS), min(r["offset"] + r["size"], (block + 1) * M.BLOCK_WORDS)
            pieces += [(turn, a - r["offset"], b - a, shard) for turn, shard in at[r["source_no"], block] if b > a]
        out.setdefault((r["doc_id"], r["size"], r["source"]), []).append(sorted(pieces))
    return out


def test_mix_against_its_definition(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_SLOTS", 300)
    monkeypatch.setattr(M, "CHUNK", 3)
    monkeypatch.setattr(M, "SHARDS_AT_ONCE", 2)
    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    rows, df = _docs(spark)
    got = M.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, source, _ in rows:
        size[source] += len((text or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    goal = dict(zip(order, plain_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["n_words"] for p in r["pieces"])
        taken[r["source"]] += r["taken"]
    for s in order:  # small and capped sources too, over several shards
        assert abs(taken[s] - goal[s]) <= 3 * M.BLOCK_WORDS

    groups = df.select("doc_id", "source", M.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("key")).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))
    sources = M.weighed(groups, M.WEIGHTS)
    layout = M._laid_out(groups, sources).collect()
    ends = defaultdict(int)
    for r in sorted(layout, key=lambda r: (r["source_no"], r["offset"], r["size"])):
        assert r["offset"] == ends[r["source_no"]]  # end to end
        ends[r["source_no"]] += r["size"]
    assert {r["source_no"]: r["source_size"] for r in layout} == dict(ends)
    want = expected(layout, sources.collect(), 17)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"], r["size"], r["source"]].append([tuple(p) for p in r["pieces"]])
    assert found.keys() == want.keys()
    for k in want:
        assert sorted(found[k]) == sorted(want[k])


def test_reruns_agree(spark, monkeypatch):
    _, df = _docs(spark)
    first = sorted(map(str, M.mix_sources(df).collect()))
    monkeypatch.setattr(M, "LOT", 1)
    assert first == sorted(map(str, M.mix_sources(df.repartition(5)).collect()))


def test_very_many_sources(spark):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 5 as int))").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    got = M.mix_sources(df).agg(F.count("*"), F.sum("size"), F.sum("taken"), F.max(F.col("taken") - 3 * F.col("size")), F.sum(F.abs(F.col("taken") - F.col("target")))).first()
    assert got[0] == 200_000 and got[1] == 400_000 and got[3] == 0
    # a source has one block, so its taken words are a whole multiple of its size
    assert abs(got[2] - got[1]) < 0.2 * got[1] and got[4] < 0.5 * got[1]


def test_empty_table(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
