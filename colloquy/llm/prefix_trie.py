"""The prefix trie of conversations, level by level.

A node is a distinct sequence of first turns; its name is the smallest id among
the conversations that begin with it, which is unique within a depth.

* **Down.**  At each depth the live conversations, those that still share their
  node with another, are grouped by (parent node, next turn); the smallest id of a
  group names the new node, and its members go on with it.  A conversation that is
  alone in its node leaves: all that follows of it is a chain of nodes of its own,
  which is listed at once.  So there are as many rounds as turns that any two
  conversations share, however long one of them is.
* **Up.**  From the deepest level on, what children hold is summed by parent and
  joined to the level above: children, leaves and savings.
* **Ends.**  The ids of the conversations that end in a node are sorted by range,
  written in lots, and digested lot after lot.

Turns are known by the SHA-256 of role and text; texts do not move.  Every level
is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_groups
from .store import drop, new_path, save

#: Ids in one lot, and nodes of a chain that are listed from one row.
LOT = 8192
#: A conversation begins with so many turns of the first one of its hundred, less one.
HEADS, HUNDRED = 6, 100
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """What tells turns apart: 32 bytes; null role and text are empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, key, chars``: turns in order, numbered from 0 in each conversation.

    Rows are ordered by turn, null first, then by ``key``.  They are sorted by
    range and counted within partitions; only what a conversation has in earlier
    partitions is added, so a long conversation is no task of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_key(F.col(role_col), F.col(text_col)).alias("key"), F.char_length(text).cast("long").alias("chars"))
    ordered = own.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, 0
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            pos = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
            if last == ids[0]:
                pos[: first[1] if len(first) > 1 else len(ids)] += so_far
            last, so_far = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos.astype(np.int64))], ["part", "conv_id", "key", "chars", "pos"])

    counted = ordered.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "key", "chars").mapInArrow(count, "part long, conv_id long, key binary, chars long, pos long")
    counted = save(counted, "counted")
    # a row for each partition
    ends = counted.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last")).orderBy("part").collect()
    carried, last, so_far = [], None, 0
    for r in ends:
        before = so_far if r["first"] == last else 0
        if before:
            carried.append((r["part"], r["first"], before))
        so_far = r["last"]["pos"] + 1 + (before if r["last"]["conv_id"] == r["first"] else 0)
        last = r["last"]["conv_id"]
    # fewer rows than partitions
    moved = rows.sparkSession.createDataFrame(carried, "part long, conv_id long, before long")
    return counted.join(F.broadcast(moved), ["part", "conv_id"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "chars")


def rebuilt(turns: DataFrame, heads: int = HEADS, hundred: int = HUNDRED) -> tuple[DataFrame, DataFrame]:
    """``conv_id, turns`` of every conversation and its ``conv_id, depth, key, chars``.

    Conversation ``c`` has the first ``h`` turns of ``c - c % hundred`` (a remainder has the sign of ``c``), then its
    own after its first ``h``; ``h`` is the CRC-32 of ``c`` in decimal modulo ``heads``.
    """
    turns = save(turns, "turns")
    counts = save(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    c = F.col("conv_id")
    convs = counts.select("conv_id", "n", (c - c % hundred).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = save(convs.select("conv_id", "n", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    # a base is shared by a hundred conversations at most, each takes a few of its turns
    lent = turns.where(F.col("pos") < heads - 1).select(F.col("conv_id").alias("base"), "pos", "key", "chars")
    taken = convs.select("conv_id", "base", "h").join(lent, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "chars")
    less = convs.where("head < h AND n > h").select("conv_id", (F.col("h") - F.col("head")).alias("less"), "n")
    h = F.crc32(c.cast("string").cast("binary")) % heads
    rest = join_groups(turns.where(F.col("pos") >= h), save(less, "less"), ["conv_id"], "n", "left")
    rest = rest.select("conv_id", (F.col("pos") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "key", "chars")
    steps = taken.unionByName(rest).sortWithinPartitions("depth")
    return convs.select("conv_id", "turns"), save(steps, "steps")


def trie(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` has ``conv_id, turns`` (unique ids) and ``steps`` has ``conv_id,
    depth`` (from 1 without gaps to ``turns``)``, key, chars``.  Conversations
    without turns end in the root.  ``saved_tokens`` sums ``(n_convs - 1) * chars``
    over the subtree.  No conversation gives no node.
    """
    spark = convs.sparkSession
    convs = save(convs, "convs")
    n, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    nodes = new_path(spark, "nodes")
    null = lambda kind: F.lit(None).cast(kind)
    top = convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), null("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), "turns", null("binary").alias("key"))
    levels = [save(top, "nodes", path=f"{nodes}/level=0")]
    members = [convs.select("conv_id", F.lit(root).cast("long").alias("node"), "turns")]
    while n > 1:
        depth = len(levels)
        here = members[-1].where(F.col("turns") >= depth).join(steps.where(F.col("depth") == depth).select("conv_id", "key", "chars"), "conv_id")
        here = save(here, "here")
        groups = here.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("turns").alias("turns"))
        level = save(groups.select("conv_id", F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "chars", "turns", "key"), "nodes", path=f"{nodes}/level={depth}")
        levels.append(level)
        shared = level.where("n_convs > 1").select(F.col("parent_conv_id").alias("node"), "key", F.col("conv_id").alias("child"), "n_convs")
        n = shared.agg(F.coalesce(F.max("n_convs"), F.lit(0))).first()[0]
        members.append(save(join_groups(here, shared, ["node", "key"], "n_convs").select("conv_id", F.col("child").alias("node"), "turns"), "members"))
        drop(here)

    summed = new_path(spark, "summed")
    kids = None
    for depth in range(len(levels) - 1, -1, -1):
        alone = levels[depth].where("n_convs = 1").select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("turns") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "turns")
        several = levels[depth].where("n_convs > 1")
        if kids is not None:
            below = kids.groupBy("parent_conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            several = several.join(below.withColumnRenamed("parent_conv_id", "_parent"), F.col("conv_id") == F.col("_parent"), "left")
        else:
            several = several.select("*", null("long").alias("n_children"), null("long").alias("n_leaves"), null("long").alias("saved"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        several = several.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "turns")
        kids = save(alone.unionByName(several), "summed", path=f"{summed}/level={depth}")

    every = spark.read.schema(kids.schema).parquet(summed)
    alone, several = every.where("n_convs = 1"), every.where("n_convs > 1")
    ended = [m.where(F.col("turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id") for depth, m in enumerate(members)]
    digests = ends_digests(ended).withColumnRenamed("depth", "_depth")
    several = several.join(digests, (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("_depth")), "left")
    several = several.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = F.when(F.col("depth") == F.col("turns"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS)
    return alone.withColumn("ends_sha256", ends).select(out).unionByName(several.select(out)).unionByName(_chains(alone).withColumn("ends_sha256", ends).select(out))


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes below those that one conversation has for itself, in lots of bounded size."""
    lots = alone.where("turns > depth").select("conv_id", "turns", F.explode(F.sequence(F.col("depth") + 1, F.col("turns"), F.lit(LOT).cast("long"))).alias("first"))
    lots = lots.repartition("conv_id", "first")
    nodes = lots.select("conv_id", "turns", F.explode(F.sequence("first", F.least(F.col("first") + (LOT - 1), F.col("turns")))).alias("depth"))
    one = F.lit(1).cast("long")
    return nodes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("turns")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "turns")


def ends_digests(ended: list[DataFrame]) -> DataFrame:
    """``depth, node, ends_sha256``: SHA-256 of each node's ids in decimal, ascending, joined by commas.

    The ids are sorted by range and written in lots of ``LOT``; a digest then
    reads its lots in order and keeps no more than one of them.
    """
    rows = ended[0]
    for more in ended[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, node, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])]) if len(ids) else np.zeros(0, np.int64)
            cuts = [x for a, b in zip(cuts, [*cuts[1:], len(ids)]) for x in range(a, b, LOT)]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(node[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], ["depth", "node", "first", "ids"])

    kept = save(rows.mapInArrow(lots, "depth long, node long, first long, ids string"), "ends")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (depth, node) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(*now, state.hexdigest())])

    dealt = kept.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").select("depth", "node", "ids")
    return dealt.mapInArrow(digest, "depth long, node long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(text, pa.string())], ["depth", "node", "ends_sha256"])


def conversation_trie(rows: DataFrame, heads: int = HEADS, hundred: int = HUNDRED) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    Rows without a conv_id belong to no conversation.  A null turn comes first;
    rows of one turn are ordered by the digest of role and text, and repeated rows
    are turns of their own.  Null roles and texts are empty.  Other columns are not
    read.  An empty table gives an empty result.
    """
    return trie(*rebuilt(numbered(rows), heads, hundred))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt ``conversations``."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = rf"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, chars
             FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
     n AS (SELECT c, count(*) AS n FROM own GROUP BY c),
     crc AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % {HEADS} AS h FROM n),
     step AS (SELECT crc.c, pos + 1 AS depth, k, chars FROM crc JOIN own ON own.c = crc.c - crc.c % {HUNDRED} AND pos < h
              UNION ALL
              SELECT c, coalesce(least(h, b.n), 0) + pos - h + 1, k, chars FROM own JOIN crc USING (c) LEFT JOIN (SELECT c AS base, n FROM n) b ON b.base = c - c % {HUNDRED} WHERE pos >= h),
     path AS MATERIALIZED (SELECT c, depth, chars, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY depth)) AS p FROM step
              UNION ALL SELECT c, 0, 0, '' FROM n),
     ends AS (SELECT c, max(depth) AS turns FROM path GROUP BY c),
     node AS MATERIALIZED (SELECT depth, p, min(c) AS id, count(*) AS n_convs, max(chars) AS chars, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = turns) AS ended FROM path JOIN ends USING (c) GROUP BY depth, p),
     place AS MATERIALIZED (SELECT path.c, path.depth, node.id FROM path JOIN node USING (depth, p)),
     tree AS MATERIALIZED (SELECT node.*, up.id AS parent FROM node LEFT JOIN place up ON up.c = node.id AND up.depth = node.depth - 1),
     kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL),
     full_tree AS MATERIALIZED (SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN kids ON kids.parent = tree.id AND kids.depth = tree.depth),
     sums AS (SELECT up.id, up.depth, count(*) FILTER (WHERE t.n_children = 0) AS n_leaves, CAST(sum((t.n_convs - 1) * t.chars) AS BIGINT) AS saved FROM full_tree t JOIN place up ON up.c = t.id AND up.depth <= t.depth GROUP BY ALL)
SELECT t.id AS conv_id, t.depth, t.parent AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256
FROM full_tree t JOIN sums USING (id, depth)
"""
