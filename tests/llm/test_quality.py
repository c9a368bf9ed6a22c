import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import quality as Q


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, the model is right on nearly all of the others."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", Q.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    rest = Q.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert ((rest["grade"] == 2) == rest["kept"]).mean() > 0.98
    assert rest.loc[rest["grade"] == 2, "kept"].mean() > 0.99
    assert rest.loc[rest["grade"] == 0, "kept"].mean() < 0.03
    assert rest.loc[rest["grade"] == 1, "kept"].mean() < 0.05
    means = rest.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]
    # no language is left out
    right = ((rest["grade"] == 2) == rest["kept"]).groupby(rest["lang"]).mean()
    assert len(right) == 4 and right.min() > 0.97


def plain_z(text, model):
    """The score of a text, feature by feature."""
    weight = dict(zip(model.names.tolist(), model.weights.tolist()))
    words = (text or "").encode().split()
    once, forms = Counter(), Counter()
    for w in words:
        own, form = Q.word_features(w)
        once.update(own)
        forms[form] += 1
    forms[Q.WORD_REPEATED] = sum(words[i] == words[i - 1] for i in range(1, len(words)))
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    forms[Q.LINE_REPEATED] = len(words) * (1 - len(set(lines)) / max(1, len(lines)))
    z = sum(weight.get(f, 0) * min(n, Q.MOST) / Q.MOST for f, n in once.items()) * min(1, Q.SHORT / max(1, len(set(words)))) ** 0.25
    return z + sum(weight.get(f, 0) * Q.FORM * math.sqrt(n / max(1, len(words))) for f, n in forms.items())


def test_scores_against_a_plain_scorer(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "a\na\nb b", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long"))
    model = Q.labelled_model(spark, docs, d)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(text)
    kept = {r["doc_id"] for r in Q.keep_good(docs, model).collect()}
    for r in got:
        tails = [1 / (1 + math.exp(t - plain_z(text[r["doc_id"]], model))) for t in model.thresholds]
        assert abs(r["tail_prob"] - tails[-1]) < 1e-9 and abs(r["expected_grade"] - sum(tails)) < 1e-9
        assert r["kept"] == (tails[-1] >= Q.MIN_TAIL) == (r["doc_id"] in kept)


def _loss(weights, cuts, x, grades, trust, l2):
    """Mean negative log-likelihood and ridge penalty, from their definitions."""
    z = x @ weights
    edges = [-np.inf, *cuts, np.inf]
    cdf = lambda t: 1 / (1 + np.exp(-t))
    p = [cdf(edges[g + 1] - s) - cdf(edges[g] - s) for g, s in zip(grades, z)]
    return -np.mean(np.log(p)) + l2 / 2 * sum((w / t) ** 2 for w, t in zip(weights, trust) if t)


def test_fit_is_the_least_of_its_loss():
    rng = np.random.default_rng(5)
    grades = np.repeat([0, 1, 2], 30)
    x = np.c_[2.0 - grades + rng.normal(0, 0.7, 90), (grades == 0) * (rng.random(90) < 0.6), rng.random(90)].astype(np.float32)
    rows = [(np.arange(3, dtype=np.uint32) + 10, r) for r in x]
    model = Q.fit(rows, grades, 3, steps=4000, l2=0.01, least=0.0)
    index, row = np.tile(np.arange(3), 90), np.repeat(np.arange(90), 3)
    z = Q.separation(index, x.ravel(), row, grades, 3, 3)
    trust = z**2 / (z**2 + Q.DOUBT)
    least = _loss(model.weights.astype(float), model.thresholds, x, grades, trust, 0.01)
    for step in (0.02, 0.2):
        for i in range(5):
            for sign in (-1, 1):
                w, cuts = model.weights.astype(float), model.thresholds.copy()
                if i < 3:
                    w[i] += sign * step
                else:
                    cuts[i - 3] += sign * min(step, 0.4 * (cuts[1] - cuts[0]))
                assert _loss(w, cuts, x, grades, trust, 0.01) > least - 1e-6


def test_thresholds_are_ordered_and_grades_come_back():
    rng = np.random.default_rng(0)
    grades = np.repeat([0, 1, 2, 3], 40)
    rows = [(np.array([5, 7, 10 + i % 3], dtype=np.uint32), np.array([3.0 - g, max(0.0, 3 - g + n), 0.1])) for i, (g, n) in enumerate(zip(grades, rng.normal(0, 0.1, 160)))]
    model = Q.fit(rows, grades, 4, steps=600, least=0.0)
    weight = dict(zip(model.names.tolist(), model.weights.tolist()))
    assert (np.diff(model.thresholds) > 0).all()
    z = np.array([weight[5] * r[1][0] + weight[7] * r[1][1] + weight[int(r[0][2])] * r[1][2] for r in rows])
    above = 1 / (1 + np.exp(model.thresholds[None, :] - z[:, None]))
    assert (np.diff(above, axis=1) <= 0).all()
    assert (np.round(above.sum(axis=1)) == grades).mean() > 0.9


def test_nulls_missing_labels_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", None), (2, "word " * 100_000, "z"), (2, "word", "z")], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = Q.train(docs, none)
    assert not len(model.weights) and Q.score_quality(docs, model).where("kept").count() == 5
    assert Q.score_quality(docs, model).count() == 5
    some = spark.createDataFrame([(1, 2), (None, 1), (2, None), (2, 7), (2, 0), (2, 1)], "doc_id long, grade int")
    model = Q.train(docs, some)
    assert Q.keep_good(docs, model).columns == docs.columns
    assert Q.score_quality(docs.limit(0), model).collect() == []
