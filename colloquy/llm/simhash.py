"""SimHash near-duplicate classes found with a vantage-point tree.

1. ``fingerprints`` turns each whole text into a 64-bit SimHash of its word
   shingles (XXH64, seed 42).
2. The distinct fingerprints are partitioned by Hamming distance.  A node of the
   tree has a vantage point ``v`` and a radius ``mu``; a fingerprint goes inside
   if ``d <= mu`` and outside if ``d > mu - r``.  By the triangle inequality two
   fingerprints at ``r`` or fewer bits share a leaf at least once, because the
   band ``(mu - r, mu]`` lies in both shards.  The tree comes from a bounded
   sample and only balances the shards: the answer does not depend on it.
3. Inside a shard the pairs are found exactly by a dual-tree walk with the same
   triangle bounds.  A shard gives back a spanning forest, never all pairs.
4. Forests are merged by alternating large-star and small-star rounds over
   tables in the shared folder (Kiveris et al., 2014).

A shard that stays too large (many fingerprints within one small ball cannot be
told apart by distance) is laid out on a triangle of blocks, so that every task
has a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, save

SEED = 42
#: Rows that a shard should have, and the most that one task compares.
SHARD_ROWS = 131_072
SHARD_LIMIT = 262_144
#: The tree never has more leaves than 2**MAX_DEPTH, which bounds its broadcast and its sample.
MAX_DEPTH = 16
SAMPLE_PER_LEAF = 48
#: A leaf of the walk inside a shard compares so many pairs at once.
LEAF_PAIRS = 1 << 16


def hashed_shingles(raw: bytes | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text; none for a text without words."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle_words, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype="<u8", count=len(first))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; without any all are 0."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes | None, shingle_words: int = 4) -> int:
    """The SimHash of one UTF-8 text; no words (or null) give 0."""
    return simhash(hashed_shingles(raw, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle_words) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A complete binary tree of vantage points: node i has children 2i+1, 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.points = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radii = np.full((1 << depth) - 1, 32, dtype=np.int16)
        self._build(0, sample, 0)

    def _build(self, node: int, sample: np.ndarray, level: int) -> None:
        if level == self.depth or not len(sample):
            return
        # of a few candidates, the one whose distances spread most
        tries = sample[:: max(1, len(sample) // 6)][:6]
        spread = [np.bitwise_count(sample[:2048] ^ x).astype(np.int16) for x in tries]
        self.points[node] = tries[int(np.argmax([d.std() for d in spread]))]
        away = np.bitwise_count(sample ^ self.points[node]).astype(np.int16)
        self.radii[node] = int(np.median(away))
        inside = away <= self.radii[node]
        self._build(2 * node + 1, sample[inside], level + 1)
        self._build(2 * node + 2, sample[~inside], level + 1)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: every leaf that a fingerprint must be in."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        for _ in range(self.depth):
            away = np.bitwise_count(fps[row] ^ self.points[node]).astype(np.int16)
            inside, outside = away <= self.radii[node], away > self.radii[node] - radius
            row, node = np.concatenate([row[inside], row[outside]]), np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
        return row, node - ((1 << self.depth) - 1)


class Forest:
    """Disjoint sets over 0..n-1, joined by whole arrays of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up


def link_within(fps: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, join: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Hand to ``join`` all pairs of ``left`` with ``right`` (or itself) at ``radius`` or fewer bits, many at a time."""
    same, stack = right is None, [(left, left if right is None else right, right is None)]
    while stack:
        a, b, same = stack.pop()
        if not len(a) or not len(b):
            continue
        work, parts = len(a) * len(b), []
        if work > LEAF_PAIRS:
            pivot = fps[a[len(a) // 2]]
            da = np.bitwise_count(fps[a] ^ pivot).astype(np.int16)
            db = da if same else np.bitwise_count(fps[b] ^ pivot).astype(np.int16)
            mu = int(np.median(da))
            if same:
                parts = [(a[da <= mu],) * 2 + (True,), (a[da > mu],) * 2 + (True,), (a[(da <= mu) & (da > mu - radius)], a[(da > mu) & (da <= mu + radius)], False)]
            else:
                parts = [(a[da <= mu], b[db <= mu + radius], False), (a[da > mu], b[db > mu - radius], False)]
        if parts and sum(len(x) * len(y) for x, y, _ in parts) < 0.95 * work:
            stack.extend(parts)
            continue
        rows = max(1, LEAF_PAIRS // len(b))
        for at in range(0, len(a), rows):
            i, j = np.nonzero(np.bitwise_count(fps[a[at : at + rows], None] ^ fps[b][None, :]) <= radius)
            join(a[at + i], b[j])


def _linked(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links of one shard or block pair."""
    pdf = pdf.sort_values("fp", ignore_index=True)
    fps, forest = pdf["fp"].to_numpy(np.int64).view(np.uint64), Forest(len(pdf))
    block = pdf["block"].to_numpy()
    if pdf["row_block"].iloc[0] == pdf["col_block"].iloc[0]:
        link_within(fps, np.arange(len(fps)), None, radius, forest.join)
    else:
        first = block == pdf["row_block"].iloc[0]
        link_within(fps, np.flatnonzero(first), np.flatnonzero(~first), radius, forest.join)
    tied = np.flatnonzero(forest.parent != np.arange(len(fps)))
    return pd.DataFrame({"a": pdf["fp"].to_numpy()[tied], "b": pdf["fp"].to_numpy()[forest.parent[tied]]})


def _blocks(fps: np.ndarray, n: np.ndarray) -> np.ndarray:
    mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % n.astype(np.uint64)).astype(np.int32)


def links(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints whose transitive closure is that of all links.

    ``fps`` has one row per distinct fingerprint.
    """
    spark = fps.sparkSession
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log(max(n, 1) / shard_rows) / math.log(1 / 0.67))))
    share = SAMPLE_PER_LEAF * (1 << depth) / max(n, 1)
    sample = np.empty(0, dtype=np.int64)
    if depth:
        picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = np.sort(np.array(picked.limit(2 * SAMPLE_PER_LEAF << depth).toPandas()["fp"], dtype=np.int64))
        sample = np.random.default_rng(SEED).permutation(sample)
    tree = spark.sparkContext.broadcast(VantageTree(sample.view(np.uint64), depth))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << depth, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(tree.value.route(batch.column(0).to_numpy().view(np.uint64), radius)[1], minlength=1 << depth)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["shard", "n"])

    # one row per leaf of the tree, 2**MAX_DEPTH at most
    large = fps.mapInArrow(sized, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > shard_limit).collect()
    split = np.ones(1 << depth, dtype=np.int64)
    for row in large:
        split[row["shard"]] = math.ceil(2 * row["n"] / shard_limit)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "row_block", "col_block", "block", "fp"]
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            row, leaf = tree.value.route(own, radius)
            cut = split[leaf]
            block = _blocks(own[row], cut)
            for at in range(int(cut.max(initial=0))):
                # the block pairs (block, at) in order; with one block, the pair (0, 0)
                k = np.flatnonzero(cut > at)
                low, high = np.minimum(block[k], at).astype(np.int32), np.maximum(block[k], at).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[k]), pa.array(low), pa.array(high), pa.array(block[k]), pa.array(own[row[k]].view(np.int64))], names)

    spread = fps.mapInArrow(routed, "shard long, row_block int, col_block int, block int, fp long")
    return spread.groupBy("shard", "row_block", "col_block").applyInPandas(lambda pdf: _linked(pdf, radius), "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the edges; root is the component's smallest node.

    Each round is one large-star and one small-star step, written to the shared
    folder; rounds end when the table of edges does not change.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = state(now)
    while last[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        after = save(small, "links")
        seen = state(after)
        drop(now)
        now = after
        if seen == last:
            break
        last = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Two documents are linked if their fingerprints differ in ``radius`` bits or
    fewer; ``component_id`` is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows
    with a null doc_id link others but are never the smallest id; a component of
    such rows alone has a null component_id.  Repeated rows are returned as often
    as they come.  Other columns of ``docs`` are not read.  An empty table gives
    an empty result.
    """
    marked = save(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    firsts = save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(firsts.select("fp"), radius))
    members = firsts.join(roots.withColumnRenamed("node", "fp"), "fp")
    classes = members.join(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    ids = firsts.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: ``doc_id, fingerprint, component_id``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
