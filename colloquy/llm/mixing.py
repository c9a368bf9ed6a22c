"""Mixing sources to target weights.

The words of a source, its documents laid end to end in a fixed order, are cut
into blocks of ``BLOCK_WORDS``.  Every output shard draws how many of its slots
go to each source, one multinomial draw of all its slots.  A source is to have as
many slots as its target asks for: what shards drew beyond that goes, in order of
shards, to the sources that were drawn too seldom, so totals are met however many
shards there are.  The slots of a source are numbered through; slot ``j`` takes
the block at ``permutation(j mod n)`` of pass ``j div n``, each pass with a
pseudorandom permutation of its own.  Slots meet the documents in a join on
(source, block).  No pass over a source repeats a block, and there are at most
``MAX_REPEATS``.

Sources may be many: they are ranked, weighed and drawn in tables; what is on the
driver is one number for ``CHUNK`` sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Slots of one output shard.
SHARD_SLOTS = 1 << 16
#: Sources whose counts are drawn together, after how many slots they have among them.
CHUNK = 4096
#: Shards that draw together.
SHARDS_AT_ONCE = 256
#: Different rows of a source that share one running sum.
BUCKET_ROWS = 1024
#: Equal rows that are listed together.
LOT = 1 << 16


def word_count(text: Column) -> Column:
    """Words: runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def running(rows: DataFrame, order: Sequence[str | Column], values: Mapping[str, Column]) -> DataFrame:
    """Add, for each name, the sum of its value over the rows before in ``order``.

    Ranges of rows are summed apart; only one sum for each range comes together.
    """
    # saved, as ranges must not change when a task runs again
    ranged = save(rows.withColumns({f"_{k}": v.cast("long") for k, v in values.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in values])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in values])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = ranged.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in values})
    # bases: a row for each range
    found = found.join(F.broadcast(bases), "_part")
    return found.select(*rows.columns, *[(F.col(f"_base_{k}") + F.col(f"_in_{k}")).alias(k) for k in values])


def listed(rows: DataFrame, copies: str, name: str, most: int | None = None) -> DataFrame:
    """Each row ``copies`` times (``most`` at most), with its number in ``name`` from 0."""
    names = [c for c in rows.columns if c != copies]
    lots = rows.select(*names, copies, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(LOT).cast("long"))).alias("_lot"))
    if ((rows.agg(F.max(copies)).first()[0] or 0) if most is None else most) > LOT:
        # one row, very often: not all of its copies are to be listed by one task
        lots = lots.repartition(*names, "_lot")
    return lots.select(*names, F.explode(F.sequence(F.col("_lot"), F.least(F.col("_lot") + LOT, F.col(copies)) - 1)).alias(name))


def with_targets(sources: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to ``source_size, weight``: the sum of sizes shared by weight, none above ``repeats`` times its size, the excess reshared.

    Targets are ``least(level * weight, repeats * size)``.  The level rises from
    round to round, with every source that it fills; a round is one aggregation.
    """
    size, weight = F.col("source_size"), F.col("weight")
    total, level, filled = None, 0.0, -1
    while True:
        over = level * weight > repeats * size
        n, held, open_, all_ = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, repeats * size)), F.lit(0)), F.sum(F.when(~over, weight)), F.coalesce(F.sum(size), F.lit(0))).first()
        total = all_ if total is None else total
        if n == filled or not open_:
            break
        filled, level = n, (total - held) / open_
    return sources.withColumn("target", F.least(F.lit(level) * weight, (repeats * size).cast("double")))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of ``index`` under a pseudorandom permutation of 0..n-1 for each ``key``.

    Four Feistel rounds over the next even power of two, repeated while outside.
    """
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                mixed = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _laid_out(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per document with ``offset``, its first word in its source's sequence; ``groups`` has equal rows once, with their ``copies``."""
    own = sources.select("source", "source_no", "source_size", "target", "base", "different")
    # sources are as many as they are: their size decides how they are joined
    rows = groups.join(own.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "key", "size"), F.ceil(F.col("different") / BUCKET_ROWS)))
    words = F.col("size") * F.col("copies")
    buckets = running(rows.groupBy("source_no", "_bucket").agg(F.sum(words).alias("_words")), ["source_no", "_bucket"], {"_before": F.col("_words")})
    within = W.partitionBy("source_no", "_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(words).over(within), F.lit(0)))
    rows = rows.join(buckets.select("source_no", "_bucket", "_before"), ["source_no", "_bucket"])
    rows = rows.withColumn("offset", F.col("_before") - F.col("base") + F.col("_inner"))
    rows = listed(rows.select("doc_id", "key", "source", "source_no", "source_size", "target", "size", "offset", "copies"), "copies", "nth", groups.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0])
    return rows.withColumn("offset", F.col("offset") + F.col("nth") * F.col("size"))


def drawn_counts(spark: SparkSession, sources: DataFrame, seed: int) -> DataFrame:
    """``shard, source_no, count``: the multinomial draw of every output shard from ``source_no, slots``.

    With many sources the draw is made in two steps, the slots of each chunk of
    sources and then those of its sources, which is the same distribution.
    """
    slots = sources.where("slots > 0").select(F.floor(F.col("source_no") / CHUNK).alias("chunk"), "source_no", "slots")
    chunks = slots.groupBy("chunk").agg(F.sum("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("source_no", "slots"))).alias("own"))
    # one row for CHUNK sources
    heads = chunks.select("chunk", "slots").orderBy("chunk").collect()
    total = sum(r["slots"] for r in heads)
    names, share = np.array([r["chunk"] for r in heads], dtype=np.int64), np.array([r["slots"] for r in heads], dtype=float) / max(total, 1)

    def draw_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in frame["id"] * SHARDS_AT_ONCE:
                shards = np.arange(first, min(first + SHARDS_AT_ONCE, math.ceil(total / SHARD_SLOTS)))
                counts = np.array([np.random.default_rng([seed, int(k)]).multinomial(min(SHARD_SLOTS, total - int(k) * SHARD_SLOTS), share) for k in shards])
                yield pd.DataFrame({"chunk": names, "shards": [shards.tolist()] * len(names), "counts": counts.T.tolist()})

    def draw_sources(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                number, own = np.array([x["source_no"] for x in row.own]), np.array([x["slots"] for x in row.own], dtype=float)
                for shard, n in zip(row.shards, row.counts, strict=True):
                    got = np.random.default_rng([seed, int(shard), int(row.chunk) + 1]).multinomial(int(n), own / own.sum())
                    used = np.flatnonzero(got)
                    yield pd.DataFrame({"shard": int(shard), "source_no": number[used], "count": got[used]})

    tasks = math.ceil(math.ceil(total / SHARD_SLOTS) / SHARDS_AT_ONCE)
    drawn = spark.range(0, tasks, 1, max(1, min(tasks, 2000))).mapInPandas(draw_chunks, "chunk long, shards array<long>, counts array<long>")
    return drawn.join(chunks.select("chunk", "own"), "chunk").mapInPandas(draw_sources, "shard long, source_no long, count long")


def reconciled(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """``shard, source_no, start, stop``: the drawn counts as numbers of slots, ``slots`` in all for each source."""
    before = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    drawn = save(drawn.join(sources.select("source_no", "slots"), "source_no"), "drawn")
    end = F.col("start") + F.col("count")
    kept = drawn.where("start < slots").select("shard", "source_no", "start", F.least(end, F.col("slots")).alias("stop"))
    # about the root of all slots are drawn for another source than needs them
    free = listed(drawn.where(end > F.col("slots")).select("shard", "source_no", F.least(F.col("count"), end - F.col("slots")).alias("n")), "n", "nth")
    free = running(free, ["shard", "source_no", "nth"], {"number": F.lit(1)}).select("number", "shard")
    had = drawn.groupBy("source_no").agg(F.sum("count").alias("had"))
    short = sources.where("slots > 0").join(had, "source_no", "left").select("source_no", F.coalesce("had", F.lit(0)).alias("had"), (F.col("slots") - F.coalesce("had", F.lit(0))).alias("n")).where("n > 0")
    short = running(listed(short, "n", "nth"), ["source_no", "nth"], {"number": F.lit(1)})
    moved = short.join(free, "number").select("shard", "source_no", (F.col("had") + F.col("nth")).alias("start"), (F.col("had") + F.col("nth") + 1).alias("stop"))
    return kept.unionByName(moved)


def _slots(spark: SparkSession, sources: DataFrame, seed: int) -> DataFrame:
    """``source_no, block, pass, shard``: one row for every block that the mix takes."""
    runs = reconciled(drawn_counts(spark, sources, seed), sources).join(sources.select("source_no", "blocks"), "source_no")
    # runs become slots; those of one source must not do so in one task
    runs = runs.repartition("source_no", "shard", "start")

    @F.pandas_udf(T.LongType())
    def permute(index: pd.Series, n: pd.Series, source_no: pd.Series, turn: pd.Series) -> pd.Series:
        key = (source_no.to_numpy(np.int64) * 8 + turn.to_numpy(np.int64)) * 65_537 + seed
        return pd.Series(permuted(index.to_numpy(np.int64), n.to_numpy(np.int64), key))

    j = runs.select("source_no", "shard", "blocks", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("j"))
    j = j.select("source_no", "shard", "blocks", (F.col("j") % F.col("blocks")).alias("at"), F.floor(F.col("j") / F.col("blocks")).cast("int").alias("pass"))
    return j.select("source_no", permute("at", "blocks", "source_no", "pass").alias("block"), "pass", "shard")


def weighed(groups: DataFrame, weights: Sequence[float]) -> DataFrame:
    """The sources of ``source, size, copies``: their number, size, first word, target, blocks and slots."""
    per_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("different"))
    ranked = save(running(per_source, [F.col("source").asc_nulls_last()], {"source_no": F.lit(1), "base": F.col("source_size")}), "ranked")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)).cast("int"))
    found = with_targets(ranked.withColumn("weight", weight)).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
    wanted = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    return save(found.withColumn("slots", F.least(wanted, MAX_REPEATS * F.col("blocks"))), "sources")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, key, source, size, source_size, target, taken, pieces``.

    ``pieces`` lists what the mix takes of a document: arrays of (pass, from_word,
    n_words, shard), words counted from 0.  ``key`` tells rows of one id apart
    and serves for joins back to them; by default it is a hash of the text.
    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    The same table gives the same mix in any file layout.

    Null and empty texts have size 0 and nothing is taken of them.  A null
    source is a source.  Repeated rows are documents of their own, null ids too;
    which of several equal rows gets which pieces is not determined.  Other
    columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = F.xxhash64(text_col) if key is None else key.cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    groups = save(sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")), "sizes")
    sources = weighed(groups, weights)
    rows = save(_laid_out(groups, sources).withColumn("row_no", F.monotonically_increasing_id()), "layout")

    last = F.floor((F.col("offset") + F.col("size") - 1) / BLOCK_WORDS)
    parts = rows.where("size > 0").select("row_no", "source_no", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / BLOCK_WORDS), last)).alias("block"))
    begin = F.greatest(F.col("offset"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    parts = parts.select("row_no", "source_no", "block", (begin - F.col("offset")).alias("from_word"), (end - begin).alias("n_words"))
    # slots and what is taken grow with the input, which their estimated sizes don't show
    taken = parts.join(_slots(spark, sources, seed).hint("merge"), ["source_no", "block"])
    piece = F.struct("pass", "from_word", "n_words", "shard")
    taken = taken.groupBy("row_no").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    found = rows.join(taken.hint("merge"), "row_no", "left")
    nothing = F.array().cast("array<struct<pass:int,from_word:bigint,n_words:bigint,shard:bigint>>")
    return found.select("doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", nothing).alias("pieces"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source: ``doc_id, size, source_size, target, taken``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
