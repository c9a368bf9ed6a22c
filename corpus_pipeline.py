"""From raw documents to packed training bins, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes each stage's result to the
shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.exact_dedup import exact_duplicates, normalised, parted, sha256_digest
from colloquy.llm.mixing import mix_sources
from colloquy.llm.packing import pack
from colloquy.llm.quality import keep_good, labelled_model
from colloquy.llm.similar import near_duplicates, words_digest
from colloquy.llm.store import save

#: No stage but the first can be written in SQL as a whole.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal model, fitted on ``labels``, does not reject.

    A null text counts as empty.  Repeated rows, null ids and columns of any name
    pass through as they are; an empty table stays empty.
    """
    return keep_good(docs, labelled_model(spark, docs, sf_dir))


def _whole(docs: DataFrame, **helpers: Column) -> DataFrame:
    """``row`` with all columns of ``docs``, whatever their names, and helper columns beside it."""
    return docs.select(F.struct(*docs.columns).alias("row")).select("row", *[v.alias(k) for k, v in helpers.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id.

    Null texts equal empty ones.  A null doc_id is larger than any other; of rows
    with the same doc_id and text one stays.  Only rows whose text is repeated
    move.  Other columns may have any name; an empty table stays empty.
    """
    found = exact_duplicates(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    repeated = save(found.where("copies > 1 OR NOT kept"), "repeated")
    rows = _whole(docs, digest=sha256_digest(normalised(F.col("row.text"))), id=F.col("row.doc_id"))
    some, others = parted(rows, repeated, repeated.count())
    some = some.join(repeated.withColumnRenamed("digest", "_digest"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("_digest")), "left")
    single, several = some.where("kept IS NULL OR (kept AND copies = 1)"), some.where("kept AND copies > 1")
    kept = others.select("row").unionByName(single.select("row")).unionByName(several.dropDuplicates(["id", "digest"]).select("row"))
    return kept.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word shingles, similarity 0.8 or more): that of the smallest doc_id.

    Rows without an id stay.  Null and empty texts are one group.  Repeated rows
    stay or go together.  Only rows of groups move.  Other columns may have any
    name; an empty table stays empty.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id", "digest").distinct()
    gone = save(gone, "gone")
    rows = _whole(docs, digest=words_digest(F.col("row.text")), id=F.col("row.doc_id"))
    some, others = parted(rows, gone, gone.count())
    some = some.join(gone.withColumnRenamed("digest", "_digest"), (F.col("id") == F.col("doc_id")) & (F.col("digest") == F.col("_digest")), "left_anti")
    return others.select("row").unionByName(some.select("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document, with the text taken in it.

    Nothing is taken of null and empty texts.  Null ids and sources are like any
    other; of equal rows each has its own share.  ``text`` and ``n_chars`` are
    those of what is taken, all other columns stay, whatever their names; an
    empty table stays empty.
    """
    key = lambda text, source: F.xxhash64(text, source)
    mixed = save(mix_sources(docs, key=key(F.col("text"), F.col("source"))).where("taken > 0").select("doc_id", "key", "size", "pieces"), "mixed")
    rows = _whole(docs, own_id=F.col("row.doc_id"), own_key=key(F.col("row.text"), F.col("row.source")))
    on = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key"))
    if not mixed.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        # equal rows: the n-th of them gets the n-th one's pieces
        mixed = mixed.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "key").orderBy("pieces")))
        rows = rows.withColumn("own_nth", F.row_number().over(W.partitionBy("own_id", "own_key").orderBy("own_key")))
        on = on & (F.col("own_nth") == F.col("nth"))
    rows = rows.join(mixed.hint("shuffle_hash"), on).select("row", "size", "pieces")
    words = F.filter(F.split("row.text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")

    def taken(turn: int) -> Column:
        parts = F.filter("pieces", lambda x: x["pass"] == turn)
        n = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["n_words"])
        cut = F.array_join(F.flatten(F.transform(parts, lambda x: F.slice(words, (x["from_word"] + 1).cast("int"), x["n_words"].cast("int")))), " ")
        return F.when(n == F.col("size"), F.col("row.text")).when(n > 0, cut)

    rows = rows.withColumn("taken", F.explode(F.array(*[taken(turn) for turn in range(3)]))).where("taken IS NOT NULL")
    out = {"text": F.col("taken"), "n_chars": F.length("taken").cast("long")}
    return rows.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: pieces of documents with their places; no bin holds a document twice.

    Texts without words have a row and no bin.  Rows with a null doc_id conflict
    with nothing; other columns are not read; an empty table gives no row.
    """
    return pack(docs, cluster=F.col("doc_id"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack_bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
