import hashlib
import math
import random
import zlib
from collections import defaultdict

from colloquy.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes, by listing every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))  # the remainder has the sign of c, as in SQL
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (n - 1) * (len(p[-1][1]) if p else 0)
        ended = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(kids[p]), leaves[p], saved[p], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in T.conversation_trie(df).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, node string, n int")


def test_against_every_prefix(spark, monkeypatch):
    monkeypatch.setattr(T, "LOT", 3)
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(200, 230), 305, 399, -3, -100, 1234]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ç𝄞", "a"])))
    # a long conversation, copies of one, one turn of many, rows of one turn that are equal or not, rows of no conversation
    rows += [(500, i, "user", f"t{i}") for i in range(300)]
    rows += [(c, i, "user", "same") for c in range(600, 640) for i in range(12)]
    rows += [(c, 0, "system", "hello") for c in range(700, 760)]
    rows += [(800, 0, "user", "x"), (800, 0, "user", "x"), (800, 0, "user", "y" * 100_000), (None, 0, "user", "z"), (None, None, None, None)]
    rng.shuffle(rows)
    assert found(frame(spark, rows)) == plain(rows)


def test_few_conversations_and_none(spark):
    for rows in ([], [(None, 1, "user", "x")], [(7, 0, "user", "x")], [(7, i, "user", "x") for i in range(9)], [(7, 0, None, None), (8, None, "", "")]):
        assert found(frame(spark, rows)) == plain(rows)


def test_turns_are_numbered_across_partitions(spark):
    # one conversation has nearly all rows: it spans several ranges, which are counted apart
    rows = [(5, i % 1000, "user", str(i)) for i in range(4000)] + [(c, 0, "user", "x") for c in (1, 9)]
    got = T.numbered(frame(spark, rows).repartition(8)).collect()
    assert sorted(r["pos"] for r in got if r["conv_id"] == 5) == list(range(4000))
    assert [r["pos"] for r in got if r["conv_id"] in (1, 9)] == [0, 0]


def test_lots_of_ids_give_the_digest_of_all(spark, monkeypatch):
    monkeypatch.setattr(T, "LOT", 10)
    ids = list(range(-20, 5000, 3))
    df = spark.createDataFrame([(2, 7, i) for i in ids], "depth long, node long, conv_id long").repartition(8)
    row = T.ends_digests([df]).collect()
    assert [(r["depth"], r["node"], r["ends_sha256"]) for r in row] == [(2, 7, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
