"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are dealt into bands by their norm, each of which spans a factor of two
(the last one holds all that are shorter).  In a band they are scaled by its
largest norm and get one more coordinate that makes them unit vectors, so the
largest inner product becomes the smallest angle.  A table rotates them
pseudorandomly, three times random signs and a fast Hadamard transform, and
assigns each to the nearest signed axis.

A query probes in every band the axes to which its own rotations are nearest,
over all tables together; what it meets there is reranked by the exact inner
product of the original vectors.  The ids in each bucket are counted, so a query
whose probes hold too few goes on along the axes of one table until it has met
``ENOUGH`` times what it asks for, or all of that table.

Vectors that are equal are indexed once, with the ``k + 1`` smallest of their
ids: no more of them can be among the ``k`` nearest of any query.  A bucket is
cut into as many parts as its counted rows ask for, and queries visit all parts,
so no task holds an unbounded bucket and none of its rows is left out; queries are
not held but pass by a part in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import save

TABLES = 4
#: Share of all tables' axes that a query probes.
PROBED = 1 / 4
#: Ids that a query must have met in every band, for each of the k that it asks for.
ENOUGH = 10
#: Bands of norms.
BANDS = 16
ROTATIONS = 3
SEED = 23
#: Rows of the index that one task looks through.
PART_ROWS = 16_384
MOST = float(np.finfo(float).max)


def usable(embedding: Column) -> Column:
    """True for vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, width = a.shape
    step = 1
    while step < width:
        pairs = a.reshape(n, -1, 2, step)
        a = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return a / np.sqrt(width)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms; those of very large or small components neither overflow nor vanish."""
    scale = np.maximum(np.abs(vectors).max(axis=1, initial=0), np.finfo(float).tiny)
    return np.minimum(scale * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1)), MOST)


class CrossPolytope:
    """Hash tables for vectors of ``dim`` components and norms up to ``largest``."""

    def __init__(self, dim: int, largest: float, tables: int = TABLES, seed: int = SEED):
        self.dim, self.largest, self.width = dim, largest, 1 << dim.bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, ROTATIONS, self.width))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """0 for norms above half of the largest, 1 for those above a quarter ..."""
        return np.clip(np.floor(np.log2(self.largest) - np.log2(sizes)), 0, BANDS - 1).astype(np.int64)

    def _spun(self, x: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            x = hadamard(x * signs)
        return np.stack([x, -x], axis=2).reshape(len(x), -1)

    def bucket(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axis: 2i is +axis i, 2i + 1 is -axis i."""
        sizes = norms(vectors)
        x = np.zeros((len(vectors), self.width))
        x[:, : self.dim] = vectors / self.largest * (2.0 ** self.band(sizes))[:, None]
        x[:, self.dim] = np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))
        return self._spun(x, table).argmax(axis=1)

    def nearness(self, queries: np.ndarray) -> np.ndarray:
        """Of each query to each signed axis of each table: (query, table, axis)."""
        x = np.zeros((len(queries), self.width))
        x[:, : self.dim] = queries / norms(queries)[:, None]
        return np.stack([self._spun(x, t) for t in range(len(self.signs))], axis=1)


def probes_of(near: np.ndarray, ids: np.ndarray, share: float, enough: int) -> list[tuple[int, int]]:
    """(table, axis) pairs that one query probes in one band.

    ``near`` and ``ids`` are nearness and number of ids by table and axis.  The
    nearest ``share`` of all axes, and then those of the table that has the most
    ids so far, until it has ``enough`` or has been probed whole.
    """
    tables, axes = near.shape
    chosen = np.zeros(near.shape, dtype=bool)
    chosen.flat[np.argsort(-near, axis=None, kind="stable")[: max(1, round(tables * axes * share))]] = True
    met = (ids * chosen).sum(axis=1)
    if met.max() < enough:
        t = int(met.argmax())
        rest = [a for a in np.argsort(-near[t], kind="stable").tolist() if not chosen[t, a] and ids[t, a]]
        for a in rest:
            chosen[t, a] = True
            met[t] += ids[t, a]
            if met[t] >= enough:
                break
    return [(int(t), int(a)) for t, a in zip(*np.nonzero(chosen & (ids > 0)), strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=float).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _passing(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """:func:`_search` over rows sorted by cell, part and ``asks``: those of the index are held until the next part begins."""
    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if batch.num_rows else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            cell, part, asks = keys[:, a].tolist()
            if (cell, part) != now:
                now, held = (cell, part), []
            rows = pa.Table.from_batches([batch.slice(a, b - a)])
            if not asks:
                held.append(rows)
            elif held:
                held = [pa.concat_tables(held).combine_chunks()]
                yield from _search(held[0], rows.combine_chunks(), dim, k).to_batches()


def _search(index: pa.Table, probes: pa.Table, dim: int, k: int) -> pa.Table:
    """The ``k`` nearest to each query among the index rows whose bucket it probes."""
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not index.num_rows or not probes.num_rows:
        return schema.empty_table()
    x, q = _matrix(index["vector"], dim), _matrix(probes["vector"], dim)
    bucket = index["bucket"].to_numpy()
    wanted = probes["buckets"].combine_chunks()
    probe_row = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
    probe_bucket = wanted.flatten().to_numpy()
    least = np.full(len(q), -np.inf)
    found = []
    for b in np.unique(bucket):
        rows, asking = np.flatnonzero(bucket == b), probe_row[probe_bucket == b]
        for at in range(0, len(asking), 1024):
            who = asking[at : at + 1024]
            near = q[who] @ x[rows].T
            if len(rows) > k:
                least[who] = np.maximum(least[who], np.partition(near, -k, axis=1)[:, -k])
            # a margin for rounding; the exact score decides below
            i, j = np.nonzero(near >= (least[who] - 1e-9 * (1 + np.abs(least[who])))[:, None] if len(rows) > k else near >= least[who][:, None] - 1e-9)
            found.append((who[i], rows[j], near[i, j]))
    if not found:
        return schema.empty_table()
    who, row, near = (np.concatenate(part) for part in zip(*found, strict=True))
    late = near >= least[who] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least[who]), least[who], 0)))
    who, row = who[late], row[late]
    score = np.concatenate([_products(q[who[at : at + 65_536]], x[row[at : at + 65_536]]) for at in range(0, len(who), 65_536)] or [np.zeros(0)])
    ids = index["ids"].combine_chunks()
    length = np.diff(ids.offsets.to_numpy())[row]
    start = (ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0])[row]
    each = np.repeat(np.arange(len(row)), length)
    vec_id = ids.flatten().to_numpy()[np.repeat(start, length) + np.arange(len(each)) - np.repeat(np.cumsum(length) - length, length)]
    who, score = who[each], score[each]
    order = np.lexsort((vec_id, -score, who))
    # a vector met in several tables counts once
    order = order[np.r_[True, (np.diff(who[order]) != 0) | (np.diff(vec_id[order]) != 0)]] if len(order) else order
    who, score, vec_id = who[order], score[order], vec_id[order]
    first = np.r_[0, np.flatnonzero(np.diff(who)) + 1]
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    top = rank < k
    return pa.table([pa.array(probes["query"].to_numpy()[who[top]]), pa.array(vec_id[top]), pa.array(score[top])], schema=schema)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probed: float = PROBED) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest, nearest first, ties to the smaller id.

    Queries are the rows for which ``is_query`` (of the id) holds; candidates are
    all rows but those with the query's own id.  Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows with a null id
    and vectors of another length than the commonest.  Repeated rows count once.
    Other columns are not read.  Without usable vectors the result is empty.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    own = own.where(F.size("vector") == dim)
    queries = own.where(is_query).distinct()

    few = W.partitionBy("vector").orderBy("id")
    smallest = own.distinct().withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    classes = save(smallest.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = save(queries.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "asked")
    longest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    norm = F.least(longest * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / longest) * (x / longest))), F.lit(MOST))
    largest = classes.agg(F.coalesce(F.max(norm), F.lit(1.0))).first()[0]
    hashes = CrossPolytope(dim, min(largest * (1 + 1e-9), MOST), tables)
    axes = 2 * hashes.width
    # the tables of a band stand below those of the band before
    used = BANDS * tables

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, ids = np.zeros(used * axes, dtype=np.int64), np.zeros(used * axes, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            band = hashes.band(norms(x))
            for t in range(tables):
                at = (band * tables + t) * axes + hashes.bucket(x, t)
                totals += np.bincount(at, minlength=used * axes)
                ids += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=used * axes).astype(np.int64)
        b = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(totals[b]), pa.array(ids[b])], ["b", "n", "ids"])

    # BANDS * tables * axes rows at most
    sizes = classes.select("vector", F.size("ids").cast("long").alias("n")).mapInArrow(counted, "b long, n long, ids long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).orderBy("b").collect()
    cell, parts, ids_in = np.zeros(used * axes, dtype=np.int64), np.ones(used * axes, dtype=np.int64), np.zeros(used * axes, dtype=np.int64)
    at, held = 0, 0
    for r in sizes:
        # neighbouring small buckets share a cell; a large one has a cell of several parts
        if held and held + r["n"] > PART_ROWS:
            at, held = at + 1, 0
        cell[r["b"]], parts[r["b"]], ids_in[r["b"]] = at, max(1, -(-r["n"] // PART_ROWS)), r["ids"]
        held = held + r["n"] if parts[r["b"]] == 1 else PART_ROWS
    ids_in = ids_in.reshape(BANDS, tables, axes)
    filled = np.flatnonzero(ids_in.any(axis=(1, 2))).tolist()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            salt = np.asarray(batch.column(2), dtype=np.int64)
            band = hashes.band(norms(x))
            for t in range(tables):
                b = (band * tables + t) * axes + hashes.bucket(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(cell[b]), pa.array(salt % parts[b]), pa.array(b), batch.column(0), batch.column(1)], ["cell", "part", "bucket", "vector", "ids"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"cell": [], "part": [], "buckets": [], "row": []}
            for i, near in enumerate(hashes.nearness(_matrix(batch.column(0), dim))):
                wanted: dict[tuple[int, int], list[int]] = {}
                for band in filled:
                    for t, axis in probes_of(near, ids_in[band], probed, ENOUGH * (k + 1)):
                        b = (band * tables + t) * axes + axis
                        for p in range(parts[b]):
                            wanted.setdefault((int(cell[b]), p), []).append(b)
                for (c, p), buckets in wanted.items():
                    for name, value in zip(out, (c, p, buckets, i), strict=True):
                        out[name].append(value)
            row = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["cell"], pa.int64()), pa.array(out["part"], pa.int64()), pa.array(out["buckets"], pa.list_(pa.int64())), batch.column(1).take(row), batch.column(0).take(row)], ["cell", "part", "buckets", "query", "vector"])

    index = classes.select("vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(1 << 30)).alias("salt")).mapInArrow(placed, "cell long, part long, bucket long, vector array<double>, ids array<long>")
    probes = asked.select("vector", "query").mapInArrow(probing, "cell long, part long, buckets array<long>, query long, vector array<double>")
    # the index rows of a part come first and are held; queries pass by in batches, however many there are
    both = index.withColumn("asks", F.lit(0)).unionByName(probes.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks").select("cell", "part", "asks", "bucket", "ids", "buckets", "query", "vector")
    met = dealt.mapInArrow(lambda batches: _passing(batches, dim, k + 1), "query long, vec_id long, score double")
    met = met.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    # a query's own id may be among k + 1, so k others are
    by_query = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    met = met.withColumn("nth", F.row_number().over(by_query)).where(F.col("nth") <= k + 1).drop("nth")
    named = queries.join(asked, "vector").select("query", F.col("id").alias("query_id"))
    pairs = named.join(met, "query").where("vec_id <> query_id")
    by_id = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
