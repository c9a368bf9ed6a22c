"""Exact deduplication through a log-structured merge index of text digests.

* **Memtable flush.**  Every task of the scan is a memtable: its digests are
  sorted and flushed as one run file with a Parquet Bloom filter on the digest.
  A run carries digests and ids, never texts.
* **Compaction** merges all runs: per digest the smallest identifier and the
  number of rows.  New documents only add runs; compacting again merges them.
* **Filter.**  Digests held more than once set bits in a filter of bounded size
  (``FILTER_BITS``), which spares the second scan from moving texts that cannot
  be hits.  A saturated filter lets more through and changes nothing else.
* **Byte verification.**  Hits are grouped by digest *and* normalised text, so
  equality is that of the bytes; map-side aggregation sends one copy of a text
  per task, however often it occurs.  Digests that turn out to hold several
  texts are resolved by text.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save

#: Bits of the duplicate filter at most: 2**26 bits are 8 MB, the most that is broadcast.
FILTER_BITS = 1 << 26
_BLOCK = 32_768  # bits of one block made by bitmap_construct_agg


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def flush_runs(docs: DataFrame, digest=sha256_digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One sorted run per task of the scan: ``digest, doc_id``."""
    rows = docs.select(digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
    return save(rows.sortWithinPartitions("digest", "doc_id"), "runs", bloom="digest")


def compact(*runs: DataFrame) -> DataFrame:
    """Merge runs: ``digest, keep_id, n``."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return merged.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def parted(rows: DataFrame, keys: DataFrame, n_keys: int, key: str = "digest") -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among those of ``keys``, and those whose key is not.

    A filter of at most FILTER_BITS tells them apart; nothing is shuffled.
    """
    bits = min(FILTER_BITS, max(_BLOCK, 1 << (16 * max(n_keys, 1)).bit_length()))
    bit = _bit(F.col(key), bits)
    blocks = keys.groupBy(F.floor(bit / _BLOCK).alias("_block")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(_BLOCK))).alias("_bitmap"))
    joined = rows.join(F.broadcast(blocks), F.floor(_bit(rows[key], bits) / _BLOCK) == blocks["_block"], "left")
    at = F.pmod(_bit(rows[key], bits), F.lit(_BLOCK))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    among = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0, F.lit(False))
    return joined.where(among).select(rows.columns), joined.where(~among).select(rows.columns)


def may_hold(rows: DataFrame, keys: DataFrame, n_keys: int, key: str = "digest") -> DataFrame:
    """The rows whose ``key`` may be among those of ``keys``."""
    return parted(rows, keys, n_keys, key)[0]


def exact_duplicates(docs: DataFrame, digest=sha256_digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, digest, keep_id, group_size, kept``.

    Of equal normalised texts the row with the smallest doc_id is kept; other
    rows of the same text, a repetition of that very row too, are not.  Null
    texts equal empty ones.  A null doc_id is larger than any other; a group
    with nothing else keeps one of its rows and has a null keep_id.  Other
    columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    runs = flush_runs(docs, digest, id_col, text_col)
    index = save(compact(runs), "index")
    many = index.where("n > 1")
    n_many = many.count()

    texts = docs.select(normalised(F.col(text_col)).alias("body"), F.col(id_col).cast("long").alias("doc_id"))
    texts = texts.withColumn("digest", digest(F.col("body")))
    # equal texts of a task are one row before anything moves; what the filter let through by chance goes after
    groups = may_hold(texts, many, n_many).groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = save(groups.select("digest", "keep_id", "group_size").join(many.select("digest"), "digest"), "classes")
    several = classes.groupBy("digest").agg(F.count("*").alias("texts"))
    collided = several.where("texts > 1").select("digest")

    # single-text digests need the digest alone; the runs already have all rows
    one = index.where("n = 1").select("digest", "keep_id", F.lit(1).cast("long").alias("group_size"))
    one = one.unionByName(classes.join(several.where("texts = 1").select("digest"), "digest").select("digest", "keep_id", "group_size"))
    rows = runs.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    found = rows.join(one, "digest").select("digest", "doc_id", "copies", "keep_id", "group_size")
    if not collided.isEmpty():
        found = found.unionByName(_resolved(texts, collided))
    ordinal = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.select("doc_id", "digest", "keep_id", "group_size", ordinal.alias("ordinal")).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("ordinal") == 1)).alias("kept")
    )


def _resolved(texts: DataFrame, collided: DataFrame) -> DataFrame:
    """The rows of digests that hold several texts, told apart by the texts themselves."""
    rows = texts.join(collided, "digest", "left_semi").groupBy("digest", "body", "doc_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return rows.join(groups, ["digest", "body"]).select("digest", "doc_id", "copies", "keep_id", "group_size")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
