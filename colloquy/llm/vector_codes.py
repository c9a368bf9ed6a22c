"""Vector codes: product codebooks by Lloyd rounds with Hamerly's bounds.

Vectors become integers, are cut into ``parts``, and each part is told by the
nearest entry of its codebook.  All arithmetic that decides is on integers.

A state table in the shared folder keeps for each row and part its entry, an upper
bound of the distance to it, and one lower bound of the distance to the second
nearest.  When the entries have moved, the upper bound grows by the way of the
own entry and the lower one shrinks by the longest way of any other.  While the
upper bound is strictly below the lower one, the entry stays the only nearest one
and nothing is computed; else the upper bound is made exact, and if that does not
do, all entries are compared, ties going to the lower index.  Bounds are kept in
32 bits, rounded away from each other.

Entries are replaced by sums per task and entry, added up in Spark.  Only the
codebooks, which do not grow with the rows, reach the driver and all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_groups
from .store import drop, save

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are kept within this, so that squared distances of up to 64 of them fit 64 bits.
MOST = 1 << 27
_UP, _DOWN = np.float32(np.inf), np.float32(0)

STATE = "vec_id long, label string, x array<int>, code binary, upper binary, lower binary, error long, scanned int"


def usable(embedding: Column) -> Column:
    """True for vectors that take part: not null, no null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), within ``MOST``."""
    return np.clip(np.floor(vectors.astype(float) * scale), -MOST, MOST).astype(np.int64)


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its length; parts are equal if that is a multiple of ``parts``."""
    return [i * dim // parts for i in range(parts + 1)]


@dataclass(frozen=True)
class Codebook:
    """Entries of all parts for vectors of one length: an array (entries, length)."""

    entries: np.ndarray
    parts: int = PARTS

    def part(self, p: int) -> np.ndarray:
        at = cuts(self.entries.shape[1], self.parts)
        return self.entries[:, at[p] : at[p + 1]]

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """Entries replaced by floor(sum / count) where parts were assigned to them."""
        out, at = self.entries.copy(), cuts(self.entries.shape[1], self.parts)
        for (p, k), (n, total) in sums.items():
            out[k, at[p] : at[p + 1]] = [int(x) // int(n) for x in total]
        return Codebook(out, self.parts)

    def sha256(self) -> str:
        numbers = (str(x) for p in range(self.parts) for entry in self.part(p).tolist() for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries)."""
    high = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * high * high * max(1, x.shape[1]) < 1 << 52:
        # every sum is an integer that doubles hold
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def own_squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its entry."""
    return ((x - entries) ** 2).sum(axis=1)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), _UP)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf).astype(np.float32), np.float32(-np.inf)), _DOWN)


def assigned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full scan: nearest entry (ties to the lower index), upper and lower bound."""
    near = squared(x, entries)
    code = near.argmin(axis=1)
    best = near[np.arange(len(x)), code]
    if near.shape[1] == 1:
        return code, _above(np.sqrt(best.astype(float))), np.full(len(x), _UP)
    near[np.arange(len(x)), code] = np.iinfo(np.int64).max
    return code, _above(np.sqrt(best.astype(float))), _below(np.sqrt(near.min(axis=1).astype(float)))


def reassigned(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and bounds after entries moved from ``before`` to ``now``, and which rows were scanned in full."""
    way = np.nextafter(np.sqrt(own_squared(now, before).astype(float)), np.inf)
    order = np.argsort(-way, kind="stable")
    longest = np.full(len(way), way[order[0]])
    longest[order[0]] = way[order[1]] if len(way) > 1 else 0.0
    code, upper, lower = code.copy(), _above(upper.astype(float) + way[code]), _below(lower.astype(float) - longest[code])
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = _above(np.sqrt(own_squared(x[open_], now[code[open_]]).astype(float)))
    scanned = open_[~(upper[open_] < lower[open_])]
    code[scanned], upper[scanned], lower[scanned] = assigned(x[scanned], now)
    return code, upper, lower, scanned


def _first_codebooks(rows: DataFrame, entries: int, parts: int, scale: int) -> dict[int, Codebook]:
    """By length: the rows of the smallest ids, in order; a null id comes last, rows of one id are ordered by vector."""
    lengths = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())
    found = {}
    for n in lengths:
        first = rows.where(F.size("embedding") == n).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
        found[n] = Codebook(integers(np.array([r["embedding"] for r in first], dtype=float).reshape(len(first), n), scale), parts)
    return found


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length, as their numbers and their matrix."""
    lengths = np.asarray(column.value_lengths())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[(starts[at][:, None] + np.arange(n)[None, :]).astype(np.int64)].reshape(len(at), n)


def _rows(binary: pa.Array, kind: type, at: np.ndarray, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), kind).reshape(-1, parts)[at]


def _assign(rows: DataFrame, now: dict[int, Codebook], before: dict[int, Codebook] | None, parts: int, scale: int) -> DataFrame:
    """The state after an assignment; ``rows`` has vectors (``embedding``) at first, then a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            codes, uppers, lowers = np.zeros((size, parts), np.uint8), np.zeros((size, parts), np.float32), np.zeros((size, parts), np.float32)
            error, scans, whole = np.zeros(size, np.int64), np.zeros(size, np.int32), [None] * size
            for at, values in _blocks(batch.column(2)):
                x = integers(values, scale) if before is None else values.astype(np.int64)
                book, edge = now[x.shape[1]], cuts(x.shape[1], parts)
                if before is not None:
                    old, up, low = _rows(batch.column(3), np.uint8, at, parts), _rows(batch.column(4), np.float32, at, parts), _rows(batch.column(5), np.float32, at, parts)
                for p in range(parts):
                    own, entries = x[:, edge[p] : edge[p + 1]], book.part(p)
                    if before is None:
                        code, upper, lower = assigned(own, entries)
                        scans[at] += 1
                    else:
                        code, upper, lower, scanned = reassigned(own, old[:, p].astype(np.int64), up[:, p], low[:, p], before[x.shape[1]].part(p), entries)
                        scans[at[scanned]] += 1
                    codes[at, p], uppers[at, p], lowers[at, p] = code, upper, lower
                    error[at] += own_squared(own, entries[code])
                for i, row in zip(at.tolist(), x.astype(np.int32)):
                    whole[i] = row
            columns = [batch.column(0), batch.column(1), pa.array(whole, pa.list_(pa.int32()))]
            columns += [pa.array([a[i].tobytes() for i in range(size)], pa.binary()) for a in (codes, uppers, lowers)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error), pa.array(scans)], ["vec_id", "label", "x", "code", "upper", "lower", "error", "scanned"])

    return rows.mapInArrow(run, STATE)


def _sums(state: DataFrame, parts: int) -> dict[int, dict[tuple[int, int], tuple[int, list[int]]]]:
    """By length, part and entry: how many parts it has, and their sums; as many numbers as the codebooks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at, x in _blocks(batch.column(0)) if batch.num_rows else ():
                codes, edge = _rows(batch.column(1), np.uint8, at, parts), cuts(x.shape[1], parts)
                for p in range(parts):
                    own = x[:, edge[p] : edge[p + 1]].astype(np.int64)
                    for k in np.unique(codes[:, p]).tolist():
                        mine = codes[:, p] == k
                        n, s = total.get((x.shape[1], p, k), (0, np.zeros(own.shape[1], np.int64)))
                        total[x.shape[1], p, k] = (n + int(mine.sum()), s + own[mine].sum(axis=0))
        names = ["length", "part", "entry", "n", "sums"]
        rows = [(*key, n, s.tolist()) for key, (n, s) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.int64()) if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows) if rows else [[]] * 5)], names)

    partial = state.select("x", "code").mapInArrow(run, "length long, part long, entry long, n long, sums array<long>")
    counts = partial.groupBy("length", "part", "entry").agg(F.sum("n").alias("n"))
    each = partial.select("length", "part", "entry", F.posexplode("sums").alias("pos", "x")).groupBy("length", "part", "entry", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    added = each.groupBy("length", "part", "entry").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("sums"))
    out: dict[int, dict] = {}
    for r in counts.join(added, ["length", "part", "entry"], "left").collect():
        out.setdefault(r["length"], {})[r["part"], r["entry"]] = (r["n"], [x["x"] for x in r["sums"] or []])
    return out


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, Codebook]]:
    """The saved state of all usable rows after the last assignment, and the codebooks by length of vectors.

    Null vectors and those with a null or non-finite component are left out.
    Vectors of each length have codebooks of their own; a length that is no
    multiple of ``parts`` is cut as evenly as it goes, and a part without
    components is always nearest to entry 0.  Fewer rows than ``entries`` give as
    many entries.  Components of more than ``MOST / scale`` count as that.
    Repeated rows and null ids are rows like any other.  Other columns are not
    read.  An empty table gives an empty state and no codebook.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a part's code is one byte: 1 to 256 entries")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    books = _first_codebooks(kept, entries, parts, scale)
    state = save(_assign(kept, books, None, parts, scale), "codes")
    for _ in range(rounds):
        sums = _sums(state, parts)
        moved = {n: book.moved(sums.get(n, {})) for n, book in books.items()}
        after = save(_assign(state, moved, books, parts, scale), "codes")
        drop(state)
        state, books = after, moved
    return state, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: ``vec_id, code, error, label_error, codebooks_sha256``."""
    state, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    labels = save(state.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n")), "labels")
    coded = join_groups(state.select("vec_id", "label", "code", "error", F.size("x").alias("length")), labels, ["label"], "n")
    # a row for each length of vectors
    digests = spark.createDataFrame([(n, book.sha256()) for n, book in books.items()], "length int, codebooks_sha256 string")
    return coded.join(F.broadcast(digests), "length").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Plain Lloyd rounds in DuckDB, every part against every entry; vectors of one length."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, p, min_by(k, d * {ENTRIES} + k) AS k, min(d) AS d FROM
                   (SELECT x.id, x.p, e.k, list_sum(list_transform(list_zip(x.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part x JOIN b{r} e ON e.p = x.p) GROUP BY id, p)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, k, list(v ORDER BY i) AS x FROM (SELECT p, k, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM
                   (SELECT a.p, a.k, generate_subscripts(x.x, 1) AS i, unnest(x.x) AS v FROM a{r} a JOIN part x ON x.id = a.id AND x.p = a.p) GROUP BY p, k, i) GROUP BY p, k),
     b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.k = b.k)""")
    joined = ",\n     ".join(steps)
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     part AS MATERIALIZED (SELECT id, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
     b0 AS MATERIALIZED (SELECT p, id AS k, x FROM part WHERE id < {ENTRIES}),
     {joined},
     book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS h FROM b{ROUNDS}),
     coded AS (SELECT id, lower(string_agg(printf('%02x', k), '' ORDER BY p)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (id), book
"""


ORACLE = _oracle()
