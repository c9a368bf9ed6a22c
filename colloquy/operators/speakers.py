"""Who speaks: matching voices to enrolled speakers, mean voices, clustering within a recording."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import cosine

THRESHOLD = 0.5
#: Enrolled speakers and voices that meet in one task, about.
ENROLLED, VOICES = 20_000, 20_000
#: Similarities that a task holds at once, besides the vectors.
CELLS = 1 << 21
#: A first merge below this share of the usual similarity is refused, once so few clusters are left.
RELATIVE_DROP, MOST_SPEAKERS = 0.8, 12
SHORT_TURN_MS = 1000
#: Fragments of a recording that are clustered in one task, and clusters of a longer one that meet in one block.
LARGEST, BLOCK = 20_000, 4096


def match_speakers(voices: DataFrame, speakers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``voice_id, speaker_id, similarity``: the most similar enrolled speaker, null below ``threshold``.

    Ties go to the smaller speaker_id.  Speakers without a vector are not
    matched; a voice without one matches nobody.  Both sides are cut into blocks
    of bounded size; every block of voices meets every block of enrolled speakers
    in one task, as products of matrices of ``CELLS`` numbers, and gives back its best alone.
    """
    known = speakers.where("embedding IS NOT NULL").select("speaker_id", "embedding")
    asked = voices.where("embedding IS NOT NULL").select("voice_id", "embedding")
    n, m = max(1, -(-asked.count() // VOICES)), max(1, -(-known.count() // ENROLLED))
    block = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
    left = asked.select(block("voice_id", n).alias("v"), every(m).alias("k"), "voice_id", "embedding")
    right = known.select(every(n).alias("v"), block("speaker_id", m).alias("k"), "speaker_id", "embedding")
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((asked, "voice_id"), (known, "speaker_id"))}
    found = left.groupBy("v", "k").cogroup(right.groupBy("v", "k")).applyInPandas(_best_of, f"voice_id {kinds['voice_id']}, speaker_id {kinds['speaker_id']}, similarity double")
    top = found.groupBy("voice_id").agg(F.max(F.struct("similarity", (-F.col("speaker_id")).alias("o"), "speaker_id")).alias("b"))
    out = voices.select("voice_id").join(top, "voice_id", "left")
    return out.select("voice_id", F.when(F.col("b.similarity") >= threshold, F.col("b.speaker_id")).alias("speaker_id"), F.col("b.similarity").alias("similarity"))


def _best_of(voices: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Each voice's best of one block; vectors of another length do not match."""
    known = known.sort_values("speaker_id", ignore_index=True)
    parts = []
    for length, own in known.groupby(known["embedding"].map(len)):
        x = voices[voices["embedding"].map(len) == length]
        if len(x):
            a, b = np.stack(x["embedding"]).astype(float), np.stack(own["embedding"]).astype(float)
            size_a, size_b, step = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), max(1, CELLS // len(b))
            best, most = np.zeros(len(a), dtype=np.int64), np.zeros(len(a))
            for i in range(0, len(a), step):
                size = size_a[i : i + step, None] * size_b
                near = np.round(np.divide(a[i : i + step] @ b.T, size, out=np.zeros_like(size), where=size > 0), 6)
                best[i : i + step] = near.argmax(axis=1)  # the first of equals: ids are in order
                most[i : i + step] = near.max(axis=1)
            parts.append(pd.DataFrame({"voice_id": x["voice_id"].to_numpy(), "speaker_id": own["speaker_id"].to_numpy()[best], "similarity": most}))
    return pd.concat(parts) if parts else pd.DataFrame({"voice_id": voices["voice_id"][:0], "speaker_id": known["speaker_id"][:0], "similarity": pd.Series(dtype="float64")})


def mean_voices(turns: DataFrame, keys: list[str], weight: str = "ms", vector: str = "embedding", shortest: int = SHORT_TURN_MS) -> DataFrame:
    """``keys, pos, x``: the weighted mean of each component, scaled to length 1.

    Turns shorter than ``shortest`` are left out where a group has longer ones.
    Sums are by group and component, so no vectors are collected.
    """
    usable = turns.where(F.col(vector).isNotNull() & (F.col(weight) > 0))
    long_ = usable.groupBy(*keys).agg(F.max(weight).alias("_most"))
    rows = usable.join(long_, keys).where((F.col("_most") < shortest) | (F.col(weight) >= shortest))
    cells = rows.select(*keys, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    sizes = means.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("_size"))
    return means.join(sizes, keys).select(*keys, "pos", F.when(F.col("_size") > 0, F.col("x") / F.col("_size")).otherwise(F.col("x")).alias("x"))


def average_linkage(members: DataFrame, group: str, cluster: str, vector: str = "embedding") -> DataFrame:
    """``group, a, b, similarity``: mean cosine over pairs of members of two clusters; 0 without any pair.

    Of unit vectors the mean of all pairs is the product of the mean vectors, so
    no pairs are made: only one mean per cluster meets the others of its group.
    """
    unit = members.where(F.col(vector).isNotNull()).select(group, cluster, F.posexplode(vector).alias("pos", "x"), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("_n"))
    means = unit.groupBy(group, cluster, "pos").agg(F.avg(F.when(F.col("_n") > 0, F.col("x").cast("double") / F.col("_n")).otherwise(0.0)).alias("x"))
    vectors = means.groupBy(group, cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("v"))
    every = members.select(group, cluster).distinct().join(vectors, [group, cluster], "left")
    a, b = every.select(group, F.col(cluster).alias("a"), F.col("v").alias("va")), every.select(group, F.col(cluster).alias("b"), F.col("v").alias("vb"))
    product = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, group).where("a < b").select(group, "a", "b", F.coalesce(product, F.lit(0.0)).alias("similarity"))


def merge_chain(sums: np.ndarray, counts: np.ndarray, most: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All merges of average linkage, most similar first: (similarity, kept row, row that joins it).

    Clusters are given by sums of unit vectors and counts, so the mean similarity of
    two is a product.  A chain goes from a cluster to its nearest one until two are
    nearest to each other, which may be merged whatever else is there: each row of
    similarities is looked at a few times, not once for every merge.  ``most`` is
    the similarity of a cluster's last merge, if it comes from one.
    """
    sums, counts = sums.copy(), counts.astype(float)
    most = np.full(len(counts), np.inf) if most is None else most.astype(float).copy()
    rows = np.arange(len(counts))  # places of the clusters that are left
    alive, merges, chain = np.ones(len(counts), bool), [], []
    x, n = sums, counts
    while len(merges) < len(counts) - 1:
        if alive[rows].sum() * 2 < len(rows):
            rows = rows[alive[rows]]
        if not chain:
            chain.append(int(rows[alive[rows]][0]))
        i = chain[-1]
        near = np.round((x[rows] @ x[i]) / (n[rows] * n[i]), 12) if len(rows) < len(n) else np.round((x @ x[i]) / (n * n[i]), 12)
        near[~alive[rows] | (rows == i)] = -np.inf
        k = int(near.argmax())
        if len(chain) > 1 and near[np.searchsorted(rows, chain[-2])] >= near[k]:
            k = int(np.searchsorted(rows, chain[-2]))
        j, best = int(rows[k]), float(near[k])
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        chain = chain[:-2]
        keep, gone = min(i, j), max(i, j)
        # never above the merges that it is made of, which rounding might let it be
        best = min(best, most[i], most[j])
        merges.append((best, keep, gone))
        x[keep] += x[gone]
        n[keep] += n[gone]
        most[keep], alive[gone] = best, False
    return sorted(merges, key=lambda m: -m[0])


def accepted_merges(similarities: np.ndarray, n: int, expected: int | None = None) -> int:
    """How many merges of ``n`` clusters count; ``similarities`` are those of all, most similar first.

    Down to ``expected`` clusters; without that number merging ends before the first
    merge that is much less similar than the median of those before it.
    """
    if expected is not None and expected >= 1:
        return n - min(expected, n)
    for t in range(max(0, n - MOST_SPEAKERS), len(similarities)):
        family = (similarities[(t - 1) // 2] + similarities[t // 2]) / 2 if t else 1.0
        if similarities[t] < RELATIVE_DROP * family:
            return t
    return len(similarities)


def _tops(n: int, merges: list[tuple[float, int, int]]) -> list[int]:
    """The smallest member of each one's cluster."""
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, i, j in merges:
        i, j = top(i), top(j)
        parent[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def cluster_voices(vectors: list, mids: list[int], expected: int | None = None) -> list[int]:
    """Cluster numbers of the fragments of one recording, by average linkage.

    Merges are those of :func:`merge_chain`, as many as :func:`accepted_merges`
    takes; clusters are numbered by their first fragment.  A fragment without a
    vector joins the nearest one in time; if none has a vector, all are one.
    """
    known = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    if not known:
        return [0] * len(vectors)
    merges = merge_chain(_unit([vectors[i] for i in known]), np.ones(len(known)))
    count = accepted_merges(np.array([m[0] for m in merges]), len(known), expected)
    tops = _tops(len(known), merges[:count])
    numbers = {t: k for k, t in enumerate(sorted(set(tops)))}
    found = {f: numbers[t] for f, t in zip(known, tops)}
    at = np.array([mids[f] for f in known], dtype=float)
    return [found[i] if i in found else found[known[int(np.abs(at - mids[i]).argmin())]] for i in range(len(vectors))]


def cluster_fragments(fragments: DataFrame, expected: str | None = None, largest: int = LARGEST, store: str | None = None) -> DataFrame:
    """``recording_id, fragment_no, cluster`` from recording_id, fragment_no, mid_ms, embedding.

    ``expected`` names a column with the stated number of speakers.  A recording of
    at most ``largest`` fragments is one group.  The fragments of a longer one are
    first merged by :func:`mutual_rounds`, which needs ``store``, a folder that all
    executors share; then its clusters are one group.
    """
    columns = ["recording_id", "fragment_no", "mid_ms", "embedding", *([expected] if expected else [])]
    kind = {f.name: f.dataType.simpleString() for f in fragments.schema}
    schema = f"recording_id {kind['recording_id']}, fragment_no {kind['fragment_no']}, cluster int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fragment_no", ignore_index=True)
        n = frame[expected].iloc[0] if expected else None
        out = cluster_voices(frame["embedding"].tolist(), frame["mid_ms"].tolist(), None if n is None or pd.isna(n) else int(n))
        return pd.DataFrame({"recording_id": frame["recording_id"], "fragment_no": frame["fragment_no"], "cluster": out})

    rows = fragments.select(*columns)
    if store is None:
        return rows.groupBy("recording_id").applyInPandas(run, schema)
    sizes = rows.groupBy("recording_id").count()
    long_ = sizes.where(F.col("count") > largest).select("recording_id")
    short = rows.join(long_, "recording_id", "left_anti").groupBy("recording_id").applyInPandas(run, schema)
    return short.unionByName(_cluster_long(rows.join(long_, "recording_id", "left_semi"), expected, largest, store, schema))


def _nearest_clusters(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Each cluster's most similar other one of a block, ``CELLS`` similarities at a time."""
    right = right.sort_values("other", ignore_index=True)
    a, b = np.stack(left["v"]), np.stack(right["w"])
    slots, others, n, m = left["slot"].to_numpy(), right["other"].to_numpy(), left["n"].to_numpy(float), right["m"].to_numpy(float)
    best, most, step = np.zeros(len(a), dtype=np.int64), np.zeros(len(a)), max(1, CELLS // len(b))
    for i in range(0, len(a), step):
        near = a[i : i + step] @ b.T
        near /= n[i : i + step, None] * m
        np.round(near, 12, out=near)
        near[slots[i : i + step, None] == others] = -np.inf
        best[i : i + step] = near.argmax(axis=1)  # the smallest of equals
        most[i : i + step] = near.max(axis=1)
    out = pd.DataFrame({"recording_id": left["recording_id"].to_numpy(), "slot": slots, "other": others[best], "similarity": most})
    return out[np.isfinite(out["similarity"])]


def mutual_rounds(clusters: DataFrame, largest: int, store: str) -> tuple[DataFrame, DataFrame]:
    """Merge clusters that are each other's nearest, round by round, until every recording has at most ``largest``.

    ``clusters`` has recording_id, slot, v (a sum of unit vectors) and n.  Returns
    the clusters that are left and the merges ``recording_id, slot, gone,
    similarity``.  Two clusters that are nearest to each other are merged by average
    linkage sooner or later, whatever else is merged before, so the order does not
    matter.  Each round compares blocks of ``BLOCK`` clusters, ``CELLS`` similarities
    at a time, and is a table.
    """
    run = uuid.uuid4().hex

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store}/clusters-{run}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{store}/clusters-{run}/{name}")

    rows = saved(clusters.select("recording_id", "slot", "v", "n", F.lit(float("inf")).alias("most")), "start")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest_clusters(left, right) if len(left) and len(right) else pd.DataFrame({"recording_id": left["recording_id"][:0], "slot": left["slot"][:0], "other": left["slot"][:0], "similarity": pd.Series(dtype="float64")})

    merges, turn = None, 0
    while True:
        sizes = rows.groupBy("recording_id").count().where(F.col("count") > largest)
        if sizes.isEmpty():
            break
        open_ = rows.join(sizes.select("recording_id", F.ceil(F.col("count") / BLOCK).alias("blocks")), "recording_id")
        block, every = F.pmod(F.xxhash64("slot"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        left = open_.select("recording_id", block.alias("a"), every.alias("b"), "slot", "v", "n")
        right = open_.select(F.col("recording_id").alias("rec"), every.alias("c"), block.alias("d"), F.col("slot").alias("other"), F.col("v").alias("w"), F.col("n").alias("m"))
        found = left.groupBy("recording_id", "a", "b").cogroup(right.groupBy("rec", "c", "d")).applyInPandas(both, f"recording_id {kinds['recording_id']}, slot {kinds['slot']}, other {kinds['slot']}, similarity double")
        best = saved(found.groupBy("recording_id", "slot").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("m")).select("recording_id", "slot", (-F.col("m.o")).alias("other"), "m.similarity"), f"best-{turn}")
        back = best.select("recording_id", F.col("slot").alias("other"), F.col("other").alias("slot"))
        pairs = best.join(back, ["recording_id", "slot", "other"]).where("slot < other").select("recording_id", "slot", F.col("other").alias("gone"), "similarity")
        pairs = saved(pairs, f"merges-{turn}")
        joins = pairs.select("recording_id", F.col("gone").alias("slot"), F.col("slot").alias("into"), "similarity")
        moved = rows.join(joins.unionByName(pairs.select("recording_id", "slot", F.col("slot").alias("into"), "similarity")), ["recording_id", "slot"], "left")
        moved = moved.select("recording_id", F.coalesce("into", "slot").alias("slot"), "v", "n", F.least("most", "similarity").alias("most"))
        # two rows at most for each slot
        parts = moved.groupBy("recording_id", "slot").agg(F.collect_list("v").alias("vs"), F.sum("n").alias("n"), F.min("most").alias("most"))
        added = F.when(F.size("vs") == 1, F.col("vs")[0]).otherwise(F.zip_with(F.col("vs")[0], F.get("vs", F.lit(1)), lambda x, y: x + y))
        rows = saved(parts.select("recording_id", "slot", added.alias("v"), "n", "most"), f"round-{turn}")
        done = pairs.select("recording_id", "slot", "gone", "similarity", F.lit(turn).alias("turn"))
        merges, turn = done if merges is None else merges.unionByName(done), turn + 1
    none = f"recording_id {kinds['recording_id']}, slot {kinds['slot']}, gone {kinds['slot']}, similarity double, turn int"
    return rows, merges if merges is not None else rows.sparkSession.createDataFrame([], none)


def _cluster_long(rows: DataFrame, expected: str | None, largest: int, store: str, schema: str) -> DataFrame:
    """:func:`cluster_fragments` of recordings with more than ``largest`` fragments."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = F.transform("embedding", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    known = rows.where(F.size("embedding") > 0)
    left, merges = mutual_rounds(known.select("recording_id", F.col("fragment_no").alias("slot"), unit.alias("v"), F.lit(1).cast("long").alias("n")), largest, store)
    stated = rows.groupBy("recording_id").agg((F.max(expected) if expected else F.lit(None).cast("int")).alias("expected"))
    # eight bytes for each merge of a recording
    before = merges.groupBy("recording_id").agg(F.collect_list("similarity").alias("before"))
    state = left.groupBy("recording_id").agg(F.collect_list(F.struct("slot", "v", "n", "most")).alias("clusters")).join(before, "recording_id", "left").join(stated, "recording_id")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec, clusters, done, wanted in zip(frame["recording_id"], frame["clusters"], frame["before"], frame["expected"]):
                clusters = sorted(clusters, key=lambda c: c["slot"])
                slots, done = [c["slot"] for c in clusters], np.zeros(0) if done is None else np.asarray(done, dtype=float)
                chain = merge_chain(np.array([c["v"] for c in clusters], dtype=float), np.array([c["n"] for c in clusters]), np.array([c["most"] for c in clusters]))
                merges = [(s, slots[i], slots[j]) for s, i, j in chain]
                order = np.sort(np.concatenate([done, [m[0] for m in merges]]))[::-1]
                count = accepted_merges(order, len(order) + 1, None if pd.isna(wanted) else int(wanted))
                # similarities of the merges that count end here; equal ones count in the order of rounds
                extra = count - int((done >= order[count - 1]).sum()) if count else 0
                kept = merges[: max(0, extra)]
                tops = _tops(len(slots), [(s, slots.index(i), slots.index(j)) for s, i, j in kept]) if kept else list(range(len(slots)))
                yield pd.DataFrame({"recording_id": rec, "slot": slots, "top": [slots[t] for t in tops]})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    tops = state.mapInPandas(finish, f"recording_id {kind['recording_id']}, slot {kind['fragment_no']}, top {kind['fragment_no']}")
    members = known.select("recording_id", "fragment_no", "mid_ms", F.col("fragment_no").alias("slot"))
    turns = 0 if merges.isEmpty() else merges.agg(F.max("turn")).first()[0] + 1
    for turn in range(turns):
        into = merges.where(F.col("turn") == turn).select("recording_id", F.col("gone").alias("slot"), F.col("slot").alias("into"))
        members = members.join(into, ["recording_id", "slot"], "left").select("recording_id", "fragment_no", "mid_ms", F.coalesce("into", "slot").alias("slot"))
    members = members.join(tops, ["recording_id", "slot"])
    path = f"{store}/members-{uuid.uuid4().hex}"
    members.write.parquet(path)
    members = rows.sparkSession.read.schema(members.schema).parquet(path)
    numbers = members.groupBy("recording_id", "top").agg(F.min("fragment_no").alias("first"))
    # a few speakers for each recording
    numbers = numbers.withColumn("cluster", F.row_number().over(W.partitionBy("recording_id").orderBy("first")) - 1)
    found = members.join(numbers.select("recording_id", "top", "cluster"), ["recording_id", "top"])
    silent = rows.where("embedding IS NULL OR size(embedding) = 0").select("recording_id", "fragment_no", "mid_ms")
    nearest = _nearest_in_time(silent, found)
    return found.select("recording_id", "fragment_no", "cluster").unionByName(nearest)


def _nearest_in_time(silent: DataFrame, found: DataFrame) -> DataFrame:
    """The cluster of the fragment whose middle is nearest, of the first one of those that are as near; 0 if there is none."""
    both = found.select("recording_id", "mid_ms", "fragment_no", "cluster").unionByName(silent.select("recording_id", "mid_ms", "fragment_no", F.lit(None).cast("int").alias("cluster")))
    order = W.partitionBy("recording_id").orderBy("mid_ms", "fragment_no")
    told = F.when(F.col("cluster").isNotNull(), F.struct("mid_ms", "fragment_no", "cluster"))
    at = both.withColumns({"before": F.last(told, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), "after": F.first(told, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))})
    away = lambda c: F.abs(F.col(f"{c}.mid_ms") - F.col("mid_ms"))
    earlier = (away("before") < away("after")) | ((away("before") == away("after")) & (F.col("before.fragment_no") < F.col("after.fragment_no"))) | F.col("after").isNull()
    return at.where("cluster IS NULL").select("recording_id", "fragment_no", F.coalesce(F.when(F.coalesce(earlier, F.lit(False)), F.col("before.cluster")).otherwise(F.col("after.cluster")), F.lit(0)).alias("cluster"))


def similarity(a: str, b: str):
    """Cosine of two columns, rounded as results are."""
    return F.round(cosine(F.col(a), F.col(b)), 6)


def stub_speech(recordings: DataFrame, words: tuple[str, ...] = ("alpha", "bravo", "charlie", "delta", "echo"), turn_ms: int = 10_000) -> DataFrame:
    """Speech made up from a duration: ``recording_id, word_ord, w, start_ms, end_ms, local_idx``.

    Between 3 and 64 words, one per 1250 ms, spread evenly; two speakers take
    turns of ten seconds.
    """
    n = F.least(F.greatest(F.floor(F.col("duration_ms") * 4 / 5000), F.lit(3)), F.lit(64))
    rows = recordings.select("recording_id", "duration_ms", n.alias("n")).withColumn("word_ord", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.floor(F.col("duration_ms") * F.col("word_ord") / F.col("n"))
    end = F.floor(F.col("duration_ms") * (F.col("word_ord") + 1) / F.col("n"))
    word = F.get(F.array(*[F.lit(w) for w in words]), (F.col("word_ord") % len(words)).cast("int"))
    return rows.select("recording_id", "word_ord", word.alias("w"), start.alias("start_ms"), end.alias("end_ms"), (F.floor(start / turn_ms) % 2).cast("int").alias("local_idx"))
