"""A stored inverted index for keyword search, with positions.

Postings lie in folders by a hash of their lexeme, sorted in each file, so a query
opens the folders of its own lexemes and skips the rest of their row groups; no
text is read or cut into tokens again.  A stored row is a block: of one lexeme, the
ids of some chunks and its places in them as gaps, in bytes of variable length.  A
task makes the blocks of its own chunks and writes them to the folders itself, so
neither texts nor postings are shuffled.

The index is kept up by layers.  Each call of :meth:`TextIndex.put` writes one
layer: the postings of chunks that are new or changed, and the ids of all chunks
that it speaks for.  A posting counts while no later layer names its chunk;
:meth:`TextIndex.compact` writes what counts as one layer and takes it in place of
the others.  A layer is seen once its marker is written, so a writer that fails
leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexemes
from ..sources.files import delete_path, names_in, write_text
from .search import Scope, clamped, cover_density, widened

BUCKETS = 64
#: Files of one folder in a compacted layer: the postings of one lexeme are dealt over so many tasks.
SPREAD = 8
#: Places that a task gathers before it makes blocks of them; one chunk's places stay together.
PLACES = 1_000_000
#: Bytes of text that are cut into tokens at once, and bytes of blocks that are opened at once; a row is whole.
BYTES = 2_000_000
#: Values that become bytes at once.
VALUES = 1 << 17


def bucket_of(lexeme: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of at most ``most`` together, or one row, as (start, number)."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield start, end - start
        start = end


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gaps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before it, but whole where a run begins."""
    before = np.concatenate([values[:1], values[:-1]])
    return np.where(first, values, values - before)


def _summed(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of runs of these sizes (none is empty) from their gaps."""
    total, start = np.cumsum(gaps), np.cumsum(sizes) - sizes
    return total - np.repeat(total[start] - gaps[start], sizes)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned values, seven bits a byte, the last byte of each below 128; and the number of bytes of each."""
    done = [_some_to_bytes(values[i : i + VALUES]) for i in range(0, len(values), VALUES)] or [_some_to_bytes(values)]
    return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])


def _some_to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.ones(len(values), dtype=np.uint8)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        length += more
    end = np.cumsum(length, dtype=np.int64)
    out = np.empty(int(length.sum(dtype=np.int64)), dtype=np.uint8)
    for i in range(int(length.max(initial=0))):
        some = np.flatnonzero(length > i)
        out[end[some] - length[some] + i] = (values[some] >> np.uint64(7 * i) & np.uint64(127)).astype(np.uint8) | np.where(length[some] > i + 1, 128, 0).astype(np.uint8)
    return out, length


def _from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of :func:`_to_bytes`, and where each ends."""
    end = np.flatnonzero(data < 128) + 1
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    shift = np.uint64(7) * (np.arange(len(data)) - np.repeat(start, end - start)).astype(np.uint64)
    return np.add.reduceat((data & 127).astype(np.uint64) << shift, start) if len(data) else np.zeros(0, dtype=np.uint64), end


def _block_rows(names: pa.Array, code: np.ndarray, chunk: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """``lexeme, block`` from places: the number of a lexeme in ``names``, a chunk's id and a position, in the order of positions."""
    ids, rank = np.unique(chunk, return_inverse=True)
    key = code.astype(np.int64) << 32 | rank
    del code, chunk, rank
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    del order
    opens = np.concatenate([[True], key[1:] != key[:-1]])
    posting = np.flatnonzero(opens)
    count, key = np.diff(np.concatenate([posting, [len(pos)]])), key[posting]
    opens_row = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
    row = np.flatnonzero(opens_row)
    n = np.diff(np.concatenate([row, [len(key)]]))
    places = np.add.reduceat(count, row)
    # the first id of a block may be negative: its sign goes to the lowest bit
    of = ids[key & 0xFFFFFFFF]
    signed = (of << 1) ^ (of >> 63)
    # a block: how many chunks, gaps of their ids, numbers of places, gaps of places
    size = 1 + 2 * n + places
    start = np.cumsum(size) - size
    values = np.empty(int(size.sum()), dtype=np.uint64)
    values[start] = n.astype(np.uint64)
    at = np.repeat(start + 1, n) + _within(n)
    values[at] = np.where(opens_row, signed, _gaps(of, opens_row)).astype(np.uint64)
    values[at + np.repeat(n, n)] = count.astype(np.uint64)
    values[np.repeat(start + 1 + 2 * n, places) + _within(places)] = _gaps(pos, opens).astype(np.uint64)
    del at, pos, opens, of, signed, count
    data, length = _to_bytes(values)
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(length, start, dtype=np.int64))]).astype(np.int32)
    blocks = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([names.take(pa.array(key[row] >> 32)), blocks], ["lexeme", "block"])


class _Gathered:
    """Places of a task until they are :data:`PLACES`."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, named: pa.Array, chunk: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More places: their lexemes (empty and null ones are no places), chunks and positions, a chunk's own all at once."""
        named = named.dictionary_encode()
        codes = self.codes
        of = np.array([codes.setdefault(x, len(codes)) if x else -1 for x in named.dictionary.to_pylist()] + [-1], dtype=np.int32)
        code = of[pc.fill_null(named.indices, len(of) - 1).to_numpy(zero_copy_only=False)]
        some = code >= 0
        self.parts.append((code[some], chunk[some], pos[some].astype(np.int32)))
        self.n += len(self.parts[-1][0])
        if self.n >= PLACES:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            names, parts = pa.array(list(self.codes), pa.string()), [*zip(*self.parts)]
            self.__init__()
            # each kind of array is handed over as it is joined, and not held here
            yield _block_rows(names, *(np.concatenate(parts.pop(0)) for _ in range(3)))


def _blocks_of_tokens(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.Array], pa.Array] | None) -> Iterator[pa.RecordBatch]:
    """Blocks from ``chunk_id, tokens``, or from ``chunk_id, text`` if ``cut`` makes the tokens; a chunk is one row, so nothing is grouped between tasks."""
    held = _Gathered()
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        size = pc.binary_length(batch.column(1)) if cut else pc.multiply(pc.list_value_length(batch.column(1)), 8)
        for start, number in _runs(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), BYTES):
            ids, tokens = batch.slice(start, number).columns
            tokens = cut(tokens) if cut else tokens
            sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield from held.add(tokens.flatten(), np.repeat(ids.to_numpy(), sizes), _within(sizes))
    yield from held.done()


def _blocks_of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from ``lexeme, chunk_id, positions``."""
    held = _Gathered()
    for batch in batches:
        size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, number in _runs(8 * size, BYTES):
            named, ids, positions = batch.slice(start, number).columns
            each = size[start : start + number]
            yield from held.add(named.take(pa.array(np.repeat(np.arange(number), each))), np.repeat(ids.to_numpy(), each), positions.flatten().to_numpy())
    yield from held.done()


def _postings_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lexeme, chunk_id, positions`` and the other columns from ``lexeme, block`` and others."""
    for batch in batches:
        for first, number in _runs(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), BYTES):
            named, blocks, *others = batch.slice(first, number).columns
            length = pc.binary_length(blocks).to_numpy(zero_copy_only=False)
            values, end = _from_bytes(np.frombuffer(b"".join(blocks.to_pylist()), dtype=np.uint8))
            # where the values of each block begin
            start = np.searchsorted(end, np.cumsum(length) - length, "right")
            n = values[start].astype(np.int64)
            at = np.repeat(start + 1, n) + _within(n)
            ids, count = values[at].astype(np.int64), values[at + np.repeat(n, n)].astype(np.int64)
            row = np.cumsum(n) - n
            signed = values[start + 1]
            ids[row] = (signed >> np.uint64(1)).astype(np.int64) ^ -(signed & np.uint64(1)).astype(np.int64)
            places = np.add.reduceat(count, row)
            gaps = values[np.repeat(start + 1 + 2 * n, places) + _within(places)].astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_summed(gaps, count).astype(np.int32)))
            of = pa.array(np.repeat(np.arange(number), n))
            yield pa.RecordBatch.from_arrays([named.take(of), pa.array(_summed(ids, n)), positions, *(x.take(of) for x in others)], ["lexeme", "chunk_id", "positions", *batch.schema.names[2:]])


@dataclass(frozen=True)
class TextIndex:
    """Postings under ``path``; ``analyzer`` gives a text's lexemes in order, empty ones only keep a place.

    Of an analyzer in Python, ``cut`` is what it does to an array of texts; the texts then
    go to the Python workers and come back as blocks at once.
    """

    spark: SparkSession
    path: str
    analyzer: Callable[[Column], Column] = lexemes
    buckets: int = BUCKETS
    spread: int = SPREAD
    cut: Callable[[pa.Array], pa.Array] | None = None

    def layers(self) -> list[int]:
        """The numbers of the layers that count, oldest first."""
        marks = [n.split("-") for n in names_in(self.spark, f"{self.path}/done")]
        whole = max((int(m[1]) for m in marks if m[2:] == ["whole"]), default=0)
        return sorted(int(m[1]) for m in marks if int(m[1]) >= whole)

    def _blocks(self, chunks: DataFrame) -> DataFrame:
        tokens = chunks.select(F.col("chunk_id").cast("long"), "text" if self.cut else self.analyzer(F.col("text")).alias("tokens"))
        return tokens.mapInArrow(partial(_blocks_of_tokens, cut=self.cut), "lexeme string, block binary")

    def _postings(self, chunks: DataFrame) -> DataFrame:
        """What :meth:`put` stores, as rows."""
        return self._blocks(chunks).mapInArrow(_postings_of_blocks, "lexeme string, chunk_id long, positions array<int>")

    def _write(self, number: int, postings: DataFrame, named: DataFrame | None) -> None:
        blocks = postings.select("lexeme", "chunk_id", "positions").mapInArrow(_blocks_of_postings, "lexeme string, block binary")
        dealt = blocks.withColumn("bucket", bucket_of(F.col("lexeme"), self.buckets)).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(self.spread)))
        self._store(number, dealt, named)

    def _store(self, number: int, blocks: DataFrame, named: DataFrame | None) -> None:
        rows = blocks.withColumn("bucket", bucket_of(F.col("lexeme"), self.buckets)).sortWithinPartitions("bucket", "lexeme")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/layer={number}")
        if named is not None:
            named.select(F.col("chunk_id").cast("long")).distinct().write.mode("overwrite").parquet(f"{self.path}/named/layer={number}")

    def put(self, chunks: DataFrame, removed: DataFrame | None = None) -> int:
        """Index ``chunks`` (chunk_id, text; ids are unique) in place of what was known of them, and forget ``removed`` (chunk_id).

        A null text has no postings.  Returns the number of the layer.
        """
        layers = self.layers()
        number = layers[-1] + 1 if layers else 0
        named = chunks.select("chunk_id") if removed is None else chunks.select("chunk_id").unionByName(removed.select("chunk_id"))
        self._store(number, self._blocks(chunks), named if layers else None)
        write_text(self.spark, f"{self.path}/done/layer-{number}", "")
        return number

    def compact(self) -> int:
        """Write what counts as one layer, after which the others are deleted."""
        old = self.layers()
        number = old[-1] + 1
        self._write(number, self.postings().drop("bucket"), None)
        write_text(self.spark, f"{self.path}/done/layer-{number}-whole", "")
        for n in old:
            for mark in (f"layer-{n}", f"layer-{n}-whole"):
                delete_path(self.spark, f"{self.path}/done/{mark}")
            for kind in ("postings", "named"):
                delete_path(self.spark, f"{self.path}/{kind}/layer={n}")
        return number

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """``lexeme, chunk_id, positions`` that count; of ``terms`` alone, from their folders alone."""
        layers = self.layers()
        if not layers:
            raise ValueError(f"no index under {self.path}")
        base = self.spark.read.schema("lexeme string, block binary, layer int, bucket int").option("basePath", f"{self.path}/postings")
        kept = None
        for n in layers:
            rows = base.parquet(f"{self.path}/postings/layer={n}")
            kept = rows if kept is None else kept.unionByName(rows)
        if terms is not None:
            mine = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).distinct().collect()]
            kept = kept.where(F.col("bucket").isin(mine) & F.col("lexeme").isin(list(terms)))
        kept = kept.mapInArrow(_postings_of_blocks, "lexeme string, chunk_id long, positions array<int>, layer int, bucket int")
        later = [n for n in layers if names_in(self.spark, f"{self.path}/named/layer={n}")]
        if later:
            named = None
            for n in later:
                rows = self.spark.read.schema("chunk_id long").parquet(f"{self.path}/named/layer={n}").select("chunk_id", F.lit(n).alias("since"))
                named = rows if named is None else named.unionByName(rows)
            newest = named.groupBy("chunk_id").agg(F.max("since").alias("since"))
            kept = kept.join(newest, "chunk_id", "left").where("since IS NULL OR layer >= since")
        return kept.select("lexeme", "chunk_id", "positions", "bucket")

    def scores(self, query: str, query_lexemes: Sequence[str] | None = None) -> DataFrame:
        """``chunk_id, score`` of all chunks that hold every lexeme of the query, as :func:`.search.keyword_scores` has them."""
        terms = query_lexemes if query_lexemes is not None else self.spark.range(1).select(self.analyzer(F.lit(query)).alias("x")).first()["x"]
        terms = [t for t in dict.fromkeys(terms) if t]
        if not terms:
            return self.spark.createDataFrame([], "chunk_id long, score double")
        # as many entries for a chunk as the query has lexemes
        held = self.postings(terms).groupBy("chunk_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("held")).where(F.size("held") == len(terms))
        places = held.select("chunk_id", F.explode("held").alias("h")).select("chunk_id", F.col("h.lexeme").alias("term"), F.explode("h.positions").alias("pos"))
        return cover_density(places, terms)

    def search(self, scope: Scope, query: str, limit: int | None = None, query_lexemes: Sequence[str] | None = None) -> DataFrame:
        """The rows of :func:`.search.keyword_search`; of the chunks only the ids are read, and what the hits show."""
        found = self.scores(query, query_lexemes).join(scope.chunks.select("chunk_id"), "chunk_id", "left_semi")
        return widened(found, scope, clamped(limit, 20, 200))
