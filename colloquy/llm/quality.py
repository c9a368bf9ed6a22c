"""Quality by ordinal regression on graded ratings.

A rating is a grade 0, 1, ... of a document.  The model is a cumulative link:
``P(grade <= k) = sigmoid(threshold_k - w.x)`` with one weight vector ``w`` for
all grades and ordered thresholds.  ``x`` are hashed features of the text (32-bit
hashes, so that two hardly ever meet by chance): its words, their beginnings,
which the words of an inflected or compounding language share, the shapes of its
words (kinds of letters, digits and signs in order), and what it repeats.  It
yields the expected grade and the probability of the upper grades, by which
documents are selected.

Weights have either sign.  Their ridge penalty is ``L2 / trust**2``, where
``trust = z**2 / (z**2 + DOUBT)`` and ``z`` is the difference of a feature
between lower and upper grades in standard errors: a feature met once or twice is
not excluded, but has to explain what the well attested ones leave over.

The fit uses a bounded sample of rated rows (``FIT_ROWS`` per grade, chosen by a
hash of the id).  Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rated documents per grade that the fit uses at most.
FIT_ROWS = 1000
STEPS = 300
L2 = 1e-4
#: Squared standard errors at which a feature is trusted by half.
DOUBT = 6.0
MIN_TAIL = 0.5
#: A feature counts so many occurrences at most.
MOST = 3
#: Bytes of the beginnings of a word.
STARTS = (3, 4, 5, 6, 7)
#: Texts of more different words than this weigh each of them less, by the fourth root.
SHORT = 20
#: Weight of shapes and repetition against words.
FORM = 5.0
#: Words whose features a worker remembers.
CACHE_WORDS = 50_000
#: Weights nearer to zero than this are left out after the fit.
LEAST_WEIGHT = 0.01
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(x for x in range(128) if not chr(x).isalnum())
_KINDS = bytes(ord("A" if chr(x).isupper() else "a" if chr(x).isalpha() or x > 127 else "0" if chr(x).isdigit() else chr(x)) if x < 128 else ord("a") for x in range(256))
_RUN = re.compile(rb"A+|a+|0+")
_WORD, _STARTS = zlib.crc32(b"w"), [(n, zlib.crc32(b"%d" % n)) for n in STARTS]
_shapes: dict[bytes, int] = {}
WORD_REPEATED, LINE_REPEATED = zlib.crc32(b"=word"), zlib.crc32(b"=line")


def shape(word: bytes) -> bytes:
    """Runs of capitals, other letters and digits as one sign each; eight bytes at most."""
    return _RUN.sub(lambda run: run[0][:1], word.translate(_KINDS))[:8]


def word_features(word: bytes) -> tuple[tuple[int, ...], int]:
    """The hashes of a word and of its beginnings, and that of its shape."""
    bare = word.translate(_LOWER, _DROPPED)
    length = len(bare)
    own = [zlib.crc32(bare[:n], start) for n, start in _STARTS if length > n]
    if bare:
        own.append(zlib.crc32(bare, _WORD))
    kinds = word.translate(_KINDS)
    form = _shapes.get(kinds)
    if form is None:
        form = zlib.crc32(b"s" + shape(word))
        if len(kinds) <= 16 and len(_shapes) < CACHE_WORDS:
            _shapes[kinds] = form
    return tuple(own), form


def repetition(raw: bytes, words: list[bytes]) -> dict[int, float]:
    """Words that equal the one before, and the share of repeated lines, in words."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {WORD_REPEATED: sum(map(eq, words, words[1:])), LINE_REPEATED: len(words) * (1 - len(set(lines)) / max(1, len(lines)))}


def _scale(distinct: int) -> float:
    return (SHORT / max(SHORT, distinct)) ** 0.25


def features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text, for the fit; a number may come twice."""
    raw = raw or b""
    words = raw.split()
    counts, found, forms = Counter(words), Counter(), Counter(repetition(raw, words))
    for word, k in counts.items():
        own, form = word_features(word)
        forms[form] += k
        for f in own:
            found[f] += k
    where = np.array([*found, *forms], dtype=np.uint32)
    value = np.minimum(np.fromiter(found.values(), float, len(found)), MOST) / MOST * _scale(len(counts))
    return where, np.concatenate([value, FORM * np.sqrt(np.fromiter(forms.values(), float, len(forms)) / max(1, len(words)))]).astype(np.float32)


@dataclass
class OrdinalModel:
    """Sorted feature numbers, their weights, and the thresholds."""

    names: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.names.tolist(), self.weights.tolist(), strict=True))


def above(raw: bytes | None, weights: dict[int, float], thresholds: np.ndarray, cache: dict[bytes, tuple]) -> np.ndarray:
    """P(grade > k) for each threshold k.  ``cache`` keeps what words say."""
    raw = raw or b""
    words = raw.split()
    counts, found, forms = Counter(words), {}, repetition(raw, words)
    for word, k in counts.items():
        known = cache.get(word)
        if known is None:
            own, form = word_features(word)
            known = tuple(f for f in own if f in weights), form
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            if len(word) <= 64:
                cache[word] = known
        for f in known[0]:
            found[f] = found.get(f, 0) + k
        forms[known[1]] = forms.get(known[1], 0) + k
    z = _scale(len(counts)) / MOST * sum(weights[f] * min(k, MOST) for f, k in found.items())
    z += FORM * sum(weights.get(f, 0.0) * (k / max(1, len(words))) ** 0.5 for f, k in forms.items())
    return 1 / (1 + np.exp(np.clip(thresholds - z, -60, 60)))


def separation(index: np.ndarray, value: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, size: int) -> np.ndarray:
    """The largest difference of means between lower and upper grades, in standard errors."""
    best = np.zeros(size)
    for cut in range(n_grades - 1):
        mean, var = [], []
        for side in (grades > cut, grades <= cut):
            n, own = max(1, side.sum()), side[row]
            m = np.bincount(index[own], weights=value[own], minlength=size) / n
            mean.append(m)
            var.append((np.bincount(index[own], weights=value[own] ** 2, minlength=size) / n - m * m + 1e-6) / n)
        best = np.maximum(best, np.abs(mean[0] - mean[1]) / np.sqrt(var[0] + var[1]))
    return best


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = STEPS, l2: float = L2, rate: float = 0.05, doubt: float = DOUBT, least: float = LEAST_WEIGHT) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over sparse rows; weights below ``least`` are dropped at the end."""
    thresholds = np.linspace(-1.0, -1.0 + 0.1 * (n_grades - 2), n_grades - 1)
    if not rows:
        return OrdinalModel(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.float32), thresholds)
    names, index = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    index = index.astype(np.int32)
    value, row = np.concatenate([r[1] for r in rows]).astype(np.float32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    size = len(names)
    trust = separation(index, value, row, grades, n_grades, size) ** 2
    trust /= trust + doubt
    # the ridge is on weight / trust
    value *= trust[index].astype(np.float32)
    importance = 1 / len(rows)
    # thresholds are a first one and positive steps, so they stay ordered
    theta = np.zeros(size + n_grades - 1)
    theta[size:] = -1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    lower, upper = grades > 0, grades < n_grades - 1
    for step in range(1, steps + 1):
        cut = np.concatenate([theta[size : size + 1], theta[size] + np.cumsum(np.exp(theta[size + 1 :]))])
        z = np.bincount(row, weights=value * theta[index], minlength=len(rows))
        hi = np.where(upper, 1 / (1 + np.exp(-np.clip(cut[np.minimum(grades, n_grades - 2)] - z, -30, 30))), 1.0)
        lo = np.where(lower, 1 / (1 + np.exp(-np.clip(cut[np.maximum(grades - 1, 0)] - z, -30, 30))), 0.0)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p * importance, lo * (1 - lo) / p * importance
        g_cut = np.bincount(np.minimum(grades, n_grades - 2), weights=-d_hi * upper, minlength=n_grades - 1) + np.bincount(np.maximum(grades - 1, 0), weights=d_lo * lower, minlength=n_grades - 1)
        grad = np.concatenate([np.bincount(index, weights=value * (d_hi - d_lo)[row], minlength=size) + l2 * theta[:size], g_cut])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad[size], grad[size + 1 :] = tail[0], tail[1:] * np.exp(theta[size + 1 :])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = (theta[:size] * trust).astype(np.float32)
    heavy = np.abs(weights) >= least
    return OrdinalModel(names[heavy], weights[heavy], np.concatenate([theta[size : size + 1], theta[size] + np.cumsum(np.exp(theta[size + 1 :]))]))


def grade(quality: Column, toxic: Column) -> Column:
    """Grades of the ``labels`` table: 0 toxic, 1 poor, 2 good; null if neither is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def _raw(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``fit_rows`` rated documents of each grade.

    ``ratings`` has ``doc_id`` and ``grade``.  Rows with a null id or grade, or a
    grade outside 0..n_grades-1, are not used; of several ratings of a document
    the lowest counts, and of several rows of a document the smallest text.  Without ratings all weights are 0 and all texts are kept.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    picked = None
    for g in range(n_grades):
        part = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(raw) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0].astype(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "grade", "where", "value"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _raw(text_col).alias("raw"))
    # the sample has at most n_grades * fit_rows ids, and one row of each
    sample = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("raw").alias("raw")).mapInArrow(run, "doc_id long, grade int, where array<long>, value array<float>").toArrow().sort_by("doc_id")
    where, value = sample["where"].combine_chunks(), sample["value"].combine_chunks()
    ends = where.offsets.to_numpy() - where.offsets[0].as_py()
    where, value = where.flatten().to_numpy().astype(np.uint32), value.flatten().to_numpy()
    rows = [(where[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    grades = sample["grade"].to_numpy().astype(np.int64)
    del sample
    pa.default_memory_pool().release_unused()
    return fit(rows, grades, n_grades)


def score_quality(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, expected_grade, tail_prob, kept``.

    ``tail_prob`` is the probability of the highest grade; a document is kept if
    it is ``min_tail`` or more.  Null texts are empty ones and are judged by the
    thresholds alone.  Ids may be null or repeat.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, cache = shared.value.table(), shared.value.thresholds, {}
        for batch in batches:
            tails = np.array([above(raw, weights, thresholds, cache) for raw in batch.column(1).to_pylist()]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "tail_prob"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _raw(text_col).alias("raw"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double").withColumn("kept", F.col("tail_prob") >= min_tail)


def keep_good(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns as they are; nothing is shuffled.

    Null texts count as empty.  Ids may be null or repeat, columns may have any
    name; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, cache = shared.value.table(), shared.value.thresholds, {}
        for batch in batches:
            keep = [above((text or "").encode(), weights, thresholds, cache)[-1] >= min_tail for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def labelled_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    """The model fitted on the graded ``labels`` of a folder of tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: ``doc_id, expected_grade, tail_prob, kept``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, labelled_model(spark, docs, sf_dir))
