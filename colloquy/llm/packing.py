"""Conflict-constrained best-fit packing of documents into fixed-length bins.

Pieces of documents are dealt over shards by a hash of the whole row and, among
equal rows, their number, so that neither a hot source nor a large group of
copies lands in one task, and the same table gives the same bins in any file
layout.  A shard keeps its bins ordered
by residual.  Each bin carries two bitmaps: the duplicate clusters it holds, and
the sources whose quota it has reached.  A piece goes to the successor of its
length in that order; while that bin conflicts, the search moves on to the next
larger residual, so the bin found is the tightest compatible one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import normalised
from .mixing import word_count
from .store import save

CAPACITY = 8192
#: Pieces of one source that a bin may hold.
SOURCE_QUOTA = 8
#: Pieces that one shard packs.
SHARD_PIECES = 8192
#: Equal rows that are numbered together.
LOT = 1 << 16
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_offset long, bin_words long"


def pack_pieces(sizes: list[int], sources: list, clusters: list, capacity: int, source_quota: int) -> list[int]:
    """Bin numbers of pieces given in packing order.

    No bin holds two pieces of one cluster or more than ``source_quota`` of one
    source, and none exceeds ``capacity``.  A null cluster conflicts with nothing.
    """
    often = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(often))}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    held: list[int] = []  # cluster bitmap of each bin
    full: list[int] = []  # bitmap of the sources at their quota
    counts: list[Counter] = []
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        c, s = cluster_bit.get(cluster, 0), source_bit[source]
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]] & c or full[order[at][1]] & s):
            at += 1
        if at < len(order):
            residual, k = order.pop(at)
        else:
            residual, k = capacity, len(held)
            held.append(0)
            full.append(0)
            counts.append(Counter())
        held[k] |= c
        counts[k][s] += 1
        if counts[k][s] >= source_quota:
            full[k] |= s
        insort(order, (residual - size, k))
        placed.append(k)
    return placed


ORDER = [("n_words", "descending"), *[(name, "ascending") for name in ("doc_id", "piece", "start_word", "source", "cluster")]]


def _packed(pieces: pa.Table, shard: int, capacity: int, source_quota: int) -> pa.Table:
    """The bins of one shard; ids stay in Arrow, so none is rounded."""
    pieces = pieces.sort_by(ORDER)
    sizes = pieces["n_words"].to_pylist()
    placed = pack_pieces(sizes, pieces["source"].to_pylist(), pieces["cluster"].to_pylist(), capacity, source_quota)
    words: Counter[int] = Counter()
    offsets = []
    for k, n in zip(placed, sizes, strict=True):
        offsets.append(words[k])
        words[k] += n
    own = pieces.select(["doc_id", "piece", "start_word", "n_words"])
    for name, values in (("bin_id", [(shard << 32) + k for k in placed]), ("bin_offset", offsets), ("bin_words", [words[k] for k in placed])):
        own = own.append_column(name, pa.array(values, pa.int64()))
    return own


def _dealt(pieces: DataFrame, shards: int) -> DataFrame:
    """Shards as partitions, by the contents of rows alone."""
    names = pieces.columns
    groups = pieces.groupBy(*names).agg(F.count("*").alias("copies"))
    lots = groups.select(*names, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(LOT).cast("long"))).alias("lot"))
    if (groups.agg(F.max("copies")).first()[0] or 0) > LOT:
        # one row, very often: not all of its copies are to be listed by one task
        lots = lots.repartition(*names, "lot")
    rows = lots.select(*names, F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + LOT, F.col("copies")) - 1)).alias("nth"))
    return rows.repartition(shards, F.xxhash64(*names, "nth")).drop("nth")


def pack(
    docs: DataFrame, capacity: int = CAPACITY, source_quota: int = SOURCE_QUOTA, cluster: Column | None = None, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start_word, n_words, bin_id, bin_offset, bin_words``.

    Texts longer than ``capacity`` words are cut into full pieces and a rest, so
    every word is placed once.  ``cluster`` tells which documents are copies of
    each other; by default those with the same text but for white space.

    Texts without words (null ones too) give a row with n_words 0 and no bin.  A
    null source has a quota like any other; a null doc_id is packed like any
    other, a null cluster conflicts with nothing.  Repeated rows are pieces of
    their own and, being copies, share no bin.  Other columns are not read.  An empty table gives an empty result.
    """
    cluster = F.xxhash64(normalised(F.col(text_col))) if cluster is None else cluster
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), word_count(F.col(text_col)).alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    start = F.col("at") * capacity
    rows = save(rows.select("doc_id", "source", "cluster", F.col("at").cast("int").alias("piece"), start.alias("start_word"), F.least(F.lit(capacity), F.col("size") - start).alias("n_words")), "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition has about shard_pieces rows, as they are dealt by hash
        got = [x for x in batches if x.num_rows]
        if got:
            yield from _packed(pa.Table.from_batches(got), TaskContext.get().partitionId(), capacity, source_quota).to_batches()

    filled = rows.where("n_words > 0")
    shards = max(1, math.ceil(filled.count() / shard_pieces))
    packed = _dealt(filled, shards).mapInArrow(run, SCHEMA)
    none = F.lit(None).cast("long")
    empty = rows.where("n_words <= 0").select("doc_id", "piece", "start_word", "n_words", none.alias("bin_id"), none.alias("bin_offset"), none.alias("bin_words"))
    return packed.unionByName(empty)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of CAPACITY words."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
