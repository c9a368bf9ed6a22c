import random
import re

import pytest

from colloquy.llm import license_scan as L


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if w]


def plain(text, found=None, shift=L.SHIFT, least=L.LEAST):
    """The columns of one text, by looking at every place."""
    w, places, labels, share = words(text), [], set(), 0.0
    for t in found or L.templates():
        n = len(t.words)
        if t.whole:
            hits = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == t.words]
            places += [(i, t.label) for i in hits]
            continue
        at = {}
        for i in range(len(w) - 1):
            for j in range(n - 1):
                if (w[i], w[i + 1]) == t.words[j : j + 2]:
                    at.setdefault(i - j, set()).add(j)
        for d in at:
            covered = {x for e in at if abs(e - d) <= shift for j in at[e] for x in (j, j + 1)}
            share = max(share, len(covered) / n)
            if len(covered) / n >= least:
                labels.add(t.label)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else share


def made(rng):
    sentences = list(L.SENTENCES) + list(L.PHRASES)
    for _ in range(120):
        out = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                out += [rng.choice(["alpha", "the", "of", "license", "mit", "über", "x1"]) for _ in range(rng.randint(1, 30))]
            else:
                own = rng.choice(sentences).split()
                for _ in range(rng.choice([0, 0, 1, 3])):
                    i = rng.randrange(len(own))
                    own[i : i + 1] = rng.choice([[], [own[i], "indeed"], ["other"]])
                out += own
        yield rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in out)


def test_against_every_place(spark):
    texts = [*made(random.Random(5)), None, "", "...", "MIT", "mit license", "MIT License mit license, MIT-LICENSE", "the GNU General\nPublic License", "general public licensed", "mit license " * 1500, "of the " * 1000]
    rows = [(i if i % 7 else None, t, 1, 2, "m", "r") for i, t in enumerate(texts)] + [(3, "mit license", 0, 0, "", "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, template int, mask string, gram string")
    got = sorted((str(r["doc_id"]), *map(str, tuple(r)[1:])) for r in L.scan(df).collect())
    assert got == sorted((str(i), *map(str, plain(t))) for i, t, *_ in rows)
    assert L.scan(df.limit(0)).collect() == []


def test_words_added_and_left_out(spark):
    own = next(iter(L.SENTENCES)).split()
    texts = {1: own, 2: [*own[:10], "and", "freely", *own[10:]], 3: own[:12] + own[15:], 4: own[: len(own) // 2], 5: ["x"] * 70_000 + own, 6: [w for x in own for w in (x, "y")]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan(df).collect()}
    assert {i for i, (labels, _) in got.items() if labels == "mit"} == {1, 2, 3, 5}
    assert got[1][1] == got[5][1] == 1.0 and 0.8 <= got[3][1] < 1 and 0.4 < got[4][1] < 0.6 and got[6][1] == 0.0


def test_templates_are_checked(spark):
    for text in ("one", "w " * 64):
        with pytest.raises(ValueError):
            L.templates({text: "x"}, {})
    own = L.templates({"hello big world": "hi"}, {})
    df = spark.createDataFrame([(1, "Hello BIG world, hello big, big world")], "doc_id long, text string")
    row = L.scan(df, own).first()
    assert (row["n_base"], row["first_word"], row["labels"], row["score"]) == (1, 0, "hi", 1.0)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = L.op12_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
