"""An index for filtered vector search: an inverted file of half-precision codes.

Vectors are scaled to length 1 and lie in one folder for each cell, which is the
centroid that they are nearest to.  The centroids are trained on a bounded sample;
every vector is indexed.  A query first visits cells in the order of their centroids'
similarity, twice as many each time, until rows enough have come through the filters
to rank by the chunks' own vectors.  The last of these is a bar that every row of the
answer reaches.  Then all cells are visited that may hold a row above it: a cell's
farthest vector tells how near to the query any of its vectors can be.  The codes that
reach the bar, less what half precision may have cost them, are ranked by the chunks'
own vectors, so no row is missed and the scores are exact; a chunk that is gone is not
found, and one whose vector has changed is found by the new one once that is added.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import names_in
from .search import Scope, clamped, semantic_scores, widened

#: Vectors in the training sample at most, for each cell; and cells at most, which bounds sample and centroids.
SAMPLE_PER_CELL, MOST_CELLS = 64, 4096
#: Vectors that a cell should have.
CELL_ROWS = 2_000
STEPS = 8
#: Candidates that are ranked to find the bar, for each row asked for.
RERANKED = 10
#: What half precision may change in a similarity: 2^-11 of each component, and small ones by 2^-25.
CODE_ERROR = 2.0**-10


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays, and a row that is not finite is not a number."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size != 0)


def train_centroids(sample: np.ndarray, cells: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means; a cell that loses all its vectors takes the one that fits worst."""
    x = unit(sample.astype(float))
    centroids = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(steps):
        near = x @ centroids.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        lost = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[lost] = x[np.argsort(near.max(axis=1), kind="stable")[: len(lost)]]
        centroids = unit(sums)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Codes under ``path``; made by :meth:`build`, opened by :meth:`open`."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Index ``chunks`` (chunk_id, recording_id, embedding); those without a vector are left out.

        All vectors must have one length.  The sample is of the smallest hashes of ids.
        """
        spark = chunks.sparkSession
        known = chunks.where("embedding IS NOT NULL").select("chunk_id", "recording_id", "embedding")
        if cells is None:
            cells = min(MOST_CELLS, max(1, math.ceil(known.count() / CELL_ROWS)))
        sample = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_PER_CELL * cells).select("embedding").collect()
        vectors = np.array([r["embedding"] for r in sample], dtype=float) if sample else np.zeros((1, 1))
        finite = vectors[np.isfinite(vectors).all(axis=1)]
        centroids = train_centroids(finite if len(finite) else np.zeros((1, vectors.shape[1])), cells)
        index = cls(spark, path, centroids)
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index.add(known)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted((r["cell"], r["centroid"]) for r in spark.read.parquet(f"{path}/centroids").collect())
        return cls(spark, path, np.array([c for _, c in rows], dtype=float))

    def _least(self) -> np.ndarray:
        """Of each cell the least similarity of a vector to the centroid; 1 where there is none."""
        least = np.ones(len(self.centroids))
        # an index from before this was kept does not say, so its cells are always visited
        for r in self.spark.read.schema("cell int, least double").parquet(f"{self.path}/filled").groupBy("cell").agg(F.min(F.coalesce("least", F.lit(-1.0))).alias("least")).collect():
            least[r["cell"]] = r["least"]
        return least

    def add(self, chunks: DataFrame) -> None:
        """Add codes of ``chunks``; of one that is there already both stay, and the chunk's own vector decides."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(2).to_pylist()
                x = unit(np.array(vectors, dtype=float).reshape(len(vectors), -1)) if vectors else np.zeros((0, centroids.shape[1]))
                all_near = x @ centroids.T
                cell = all_near.argmax(axis=1).astype(np.int32)
                # what is not finite may be anywhere
                near = np.nan_to_num(all_near.max(axis=1), nan=-1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary()), pa.array(near), pa.array(cell)], ["chunk_id", "recording_id", "code", "near", "cell"])

        rows = chunks.where("embedding IS NOT NULL").select(F.col("chunk_id").cast("long"), F.col("recording_id").cast("long"), "embedding")
        coded = rows.mapInArrow(run, "chunk_id long, recording_id long, code binary, near double, cell int")
        batch = f"{self.path}/codes/batch={uuid.uuid4().hex}"
        # a cell is dealt over several tasks and files, as it may be large
        coded.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell").parquet(batch)
        added = self.spark.read.schema("near double, cell int").parquet(batch)
        added.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).coalesce(1).write.mode("append").parquet(f"{self.path}/filled")

    def _approximate(self, rows: DataFrame, vector: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column(1).to_pylist()
                x = np.frombuffer(b"".join(codes), np.float16).reshape(len(codes), -1).astype(float) if codes else np.zeros((0, len(vector)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x @ vector)], ["chunk_id", "near"])

        return rows.select("chunk_id", "code").mapInArrow(run, "chunk_id long, near double")

    def _nearest(self, similar: np.ndarray) -> np.ndarray:
        """How similar to the query a vector of each cell can be: its angle to the centroid is at most the farthest one's."""
        apart = np.arccos(np.clip(similar, -1, 1)) - np.arccos(np.clip(self._least(), -1, 1))
        return np.where(apart > 0, np.cos(np.maximum(apart, 0)), 1.0)

    def candidates(self, scope: Scope, vector: list[float], n: int) -> tuple[DataFrame, int]:
        """``chunk_id`` of all rows that pass the scope's filters and may be among the best ``n``, and how many cells were visited."""
        batches = names_in(self.spark, f"{self.path}/codes")
        present = {int(x.removeprefix("cell=")) for b in batches for x in names_in(self.spark, f"{self.path}/codes/{b}") if x.startswith("cell=")}
        if not present:
            return self.spark.createDataFrame([], "chunk_id long"), 0
        own = unit(np.array([vector], dtype=float))[0]
        similar = self.centroids @ own
        order = [c for c in np.argsort(-similar, kind="stable").tolist() if c in present]
        codes = self.spark.read.schema("chunk_id long, recording_id long, code binary, batch string, cell int").parquet(f"{self.path}/codes")
        allowed = scope.chunks.where("embedding IS NOT NULL").select("chunk_id")

        def visited(cells: list[int]) -> DataFrame:
            return self._approximate(codes.where(F.col("cell").isin(cells)).join(allowed, "chunk_id", "left_semi"), own)

        at, step, best = 0, max(1, len(order) // 64), {}
        while at < len(order) and len(best) < n:
            for r in visited(order[at : at + step]).groupBy("chunk_id").agg(F.max("near").alias("near")).orderBy(F.desc("near"), "chunk_id").limit(RERANKED * n).collect():
                best[r["chunk_id"]] = max(r["near"], best.get(r["chunk_id"], -2.0))
            at, step = at + step, step * 2
        if len(best) < n:
            return self.spark.createDataFrame([(i,) for i in best], "chunk_id long"), len(order)
        # codes may be of vectors that have changed, so the bar is of the chunks' own
        first = self.spark.createDataFrame([(i,) for i in sorted(best, key=lambda i: (-best[i], i))[: RERANKED * n]], "chunk_id long")
        bar = semantic_scores(scope.chunks.join(F.broadcast(first), "chunk_id"), vector).orderBy(F.desc("score")).limit(n).agg(F.min("score")).first()[0]
        bar = min(1.0, bar) if bar == bar else 1.0
        may = self._nearest(similar)
        cells = [c for c in order if may[c] >= bar - 1e-6]
        return visited(cells).where(F.col("near") >= bar - CODE_ERROR).select("chunk_id").distinct(), len({*cells, *order[:at]})

    def scores(self, scope: Scope, vector: list[float], n: int) -> DataFrame:
        """``chunk_id, score`` of candidates, exact; the best ``n`` of all chunks are among them."""
        rows, _ = self.candidates(scope, vector, n)
        return semantic_scores(scope.chunks.select("chunk_id", "embedding").join(rows, "chunk_id"), vector)

    def search(self, scope: Scope, vector: list[float], limit: int | None = None) -> DataFrame:
        """The rows of :func:`.search.semantic_search`."""
        limit = clamped(limit, 20, 200)
        return widened(self.scores(scope, vector, limit), scope, limit)
