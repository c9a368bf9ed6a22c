"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words joined by single spaces,
then one end symbol (a line feed, which no word holds).  The counts of all
contexts of up to ``DEPTH`` bytes over the whole training text make the tree:

* a context is a candidate if it occurs ``MIN_COUNT`` times or more, so a larger
  text has more of them (a caller may ask for a share of all positions instead);
* it is retained if its next-symbol distribution diverges from that of its
  longest proper suffix by ``DIVERGENCE`` nats (Kullback-Leibler) or more;
  the suffixes of a retained context are retained with it, and candidates of
  one byte (256 at most) always are;
* each distribution is smoothed towards its suffix's, the more the more different
  symbols follow it, and the root's towards the uniform one, so nothing has
  probability zero.

Scoring follows the longest retained suffix.  The tree is never in one place:

1. Tasks cut their texts into blocks of about ``BLOCK_BYTES``, which are saved.
2. A block lists its distinct grams (context and symbol) with their training
   counts, dealt into cells by the last two bytes of the context.
3. A cell adds up the counts of all blocks, makes its part of the tree and looks
   up each block's grams there; only the counts of single bytes and byte pairs
   (65 536 at most) are on the driver.
4. The block meets the logarithms.  They come in the order of its grams in that
   cell, which it lists once more, so grams are not sent back.

The unigram base needs every token's count: tokens with a share of ``FREQUENT``
or more (at most 1 / FREQUENT of them) are sent to the tasks, all others are
joined by token.
"""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save

DEPTH = 6
MIN_COUNT = 2
DIVERGENCE = 0.003
#: Weight of the suffix, for each different symbol that a context was followed by.
SMOOTHING = 6.0
FREQUENT = 2e-6
END = 0x0A
#: Bytes that a task looks at together.
SLICE_BYTES = 1 << 20
#: Texts of a batch that a task has as Python objects besides the batch.
HELD_TEXTS = 200
#: Bytes of text whose distinct grams are listed together.
BLOCK_BYTES = 16 << 20
#: Distinct tokens that a task counts before it hands them on.
HELD_TOKENS = 300_000
#: Byte strings that a task lists besides the distinct ones before it merges them.
HELD_GRAMS = 600_000
#: Ranges in which a block's distinct byte strings are merged, one after the other.
RANGES = 16
#: Training tokens for each cell of the tree.
CELL_TOKENS = 1 << 21


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def _raw(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _values(column: pa.Array) -> Iterator[bytes | None]:
    """A batch's texts, a few at a time as Python objects."""
    for k in range(0, len(column), HELD_TEXTS):
        yield from column.slice(k, HELD_TEXTS).to_pylist()


def _slices(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Groups of tokenised texts of about SLICE_BYTES, in order."""
    held, size = [], 0
    for raw in texts:
        if held and size + len(raw or b"") > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(_words(raw))
        size += len(raw or b"")
    if held:
        yield held


def token_totals(train: DataFrame) -> DataFrame:
    """``token, c`` over the training texts; the end token is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "c"])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for raw in _values(batch.column(0)):
                counts.update(_words(raw))
                counts[b""] += 1
                if len(counts) > HELD_TOKENS:
                    yield out()
                    counts = Counter()
        yield out()

    # tasks have summed up already, so rows go to their token's partition first and are aggregated once
    return train.select("raw").mapInArrow(run, "token binary, c long").repartition("token").groupBy("token").agg(F.sum("c").alias("c"))


def _laid_flat(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts, each after ``depth`` end symbols and before one; where each begins; what is predicted."""
    pad = bytes([END]) * depth
    texts = [b" ".join(w) for w in words]
    flat = np.frombuffer(b"".join(pad + x + b"\n" for x in texts), dtype=np.uint8)
    lengths = np.fromiter((len(x) + depth + 1 for x in texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(lengths) - lengths
    predicted = np.ones(len(flat), dtype=bool)
    predicted[(starts[:, None] + np.arange(depth)).ravel()] = False
    return flat, starts, predicted


def _codes(flat: np.ndarray, depth: int) -> np.ndarray:
    """For each position from ``depth`` on: its context, last byte first, then its symbol."""
    if depth == DEPTH == 6:
        # two bytes, then four, then six: narrow numbers are put together faster
        two = flat[1:].astype(np.uint16) << 8 | flat[:-1]
        four = two[2:].astype(np.uint32) << 16 | two[:-2]
        code = four[2:-1].astype(np.int64)
        for bits, low in ((16, two[:-5]), (8, flat[depth:])):
            code <<= bits
            code |= low
        return code
    code = np.zeros(len(flat) - depth, dtype=np.int64)
    for k in range(1, depth + 1):
        code = (code << 8) | flat[depth - k : len(flat) - k]
    return (code << 8) | flat[depth:]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    # sorted runs are merged, not sorted anew
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = _firsts(codes)
    return codes[first], np.add.reduceat(counts[order], first, dtype=counts.dtype) if len(first) else counts


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted; a single part is sorted in place, as nothing goes with the values."""
    codes = np.concatenate(parts) if len(parts) > 1 else parts[0]
    codes.sort(kind="stable" if len(parts) > 1 else None)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)


class Ranges:
    """Distinct codes of slices, with their counts or alone.

    They lie in ranges of about equal size, and only one range at a time is held
    twice while it is merged.
    """

    def __init__(self):
        self.bounds, self.parts, self.held = None, [[] for _ in range(RANGES)], 0

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        """``codes`` are sorted and distinct."""
        if not len(codes):
            return
        if self.bounds is None:
            self.bounds = codes[np.arange(1, RANGES) * len(codes) // RANGES]
        cuts = np.searchsorted(codes, self.bounds).tolist()
        for part, a, b in zip(self.parts, [0, *cuts], [*cuts, len(codes)], strict=True):
            if a < b:
                part.append(codes[a:b] if counts is None else (codes[a:b], counts[a:b]))
        self.held += len(codes)
        if self.held > HELD_GRAMS:
            self.held = 0
            for i, part in enumerate(self.parts):
                self.parts[i] = [self._one(part)] if part else part

    @staticmethod
    def _one(part: list) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        return _distinct(part) if isinstance(part[0], np.ndarray) else _merged(part)

    def taken(self) -> Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """The merged ranges that are not empty, in order; what is given is no longer held."""
        for i in range(RANGES):
            part, self.parts[i] = self.parts[i], []
            if part:
                yield self._one(part)


def _packed(values: np.ndarray) -> bytes:
    """Numbers, all first bytes before all second ones, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(raw: bytes, n: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def _steps(codes: np.ndarray) -> bytes:
    return _packed(np.diff(codes, prepend=0))


def _from_steps(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(raw, n, np.int64))


class Block:
    """Texts of about BLOCK_BYTES of a task's rows, as saved."""

    def __init__(self, depth: int):
        self.depth, self.size, self.texts, self.lengths, self.learns = depth, 0, [], [], []
        self.pairs = np.zeros(1 << 16, dtype=np.int64)

    def add(self, words: list[list[bytes]], train: np.ndarray) -> None:
        flat, starts, predicted = _laid_flat(words, self.depth)
        lengths = np.diff(np.r_[starts, len(flat)])
        # the first byte is not predicted, so it follows none
        known = (predicted & np.repeat(train, lengths))[1:]
        self.pairs += np.bincount((flat[:-1].astype(np.uint16) << 8 | flat[1:])[known], minlength=1 << 16)
        self.texts.append(pa.compress(flat.tobytes(), codec="zstd", asbytes=True))
        self.lengths.append(lengths.tolist())
        self.learns.append(train.tolist())
        self.size += len(flat)

    def saved(self) -> dict[str, object]:
        some = np.flatnonzero(self.pairs)
        return {"pairs": some.tolist(), "counts": self.pairs[some].tolist(), "texts": self.texts, "sizes": self.lengths, "learns": self.learns}


def _opened(texts: list[bytes], sizes: list[list[int]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice of a saved block: the codes of what is predicted, how many of them each text has, and where texts begin among them."""
    for raw, lengths in zip(texts, sizes, strict=True):
        flat = np.frombuffer(pa.decompress(raw, decompressed_size=sum(lengths), codec="zstd", asbytes=True), dtype=np.uint8)
        lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        predicted = np.ones(len(flat), dtype=bool)
        predicted[(starts[:, None] + np.arange(depth)).ravel()] = False
        n = lengths - depth
        yield _codes(flat, depth)[predicted[depth:]], n, np.cumsum(n) - n


def _listed(texts: list[bytes], sizes: list[list[int]], learns: list[list[bool]], depth: int, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``cell, codes, counts`` of the distinct grams of a block; the counts are those of its training texts."""
    found = Ranges()
    for (codes, n, _), train in zip(_opened(texts, sizes, depth), learns, strict=True):
        learned = np.repeat(np.asarray(train, dtype=bool), n)
        own, other = codes[learned], _distinct([codes[~learned]])
        # else they stay until the next slice has been opened
        del codes
        own.sort()
        first = _firsts(own)
        found.add(own[first], np.diff(np.r_[first, len(own)]).astype(np.uint32))
        found.add(other, np.zeros(len(other), dtype=np.uint32))
        del own, other, first
    dealt: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for codes, counts in found.taken():
        for cell, at in _dealt(codes, depth, cells):
            dealt.setdefault(cell, []).append((codes[at], counts[at]))
    for cell in sorted(dealt):
        yield cell, *(np.concatenate(x) for x in zip(*dealt.pop(cell), strict=True))


def _dealt(codes: np.ndarray, depth: int, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """The cells of sorted grams, and where their grams are, in order."""
    # two bytes for each gram, which are also sorted by their digits
    cell = _cell(np.arange(1 << 16, dtype=np.int64) << 8 * (depth - 1), depth, cells).astype(np.uint16)[codes >> 8 * (depth - 1)]
    order = np.argsort(cell, kind="stable")
    first = _firsts(cell[order])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=True):
        yield int(cell[order[a]]), order[a:b]


def _cell(codes: np.ndarray, depth: int, cells: int) -> np.ndarray:
    """By the last two bytes of the context."""
    last = codes >> 8 * (depth - 1)
    return (last * 0x9E3779B1 >> 7) % cells


def _divergences(c: np.ndarray, at: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Kullback-Leibler divergence of each context: counts ``c`` of its symbols, ``at`` naming it, from probabilities ``q``."""
    share = c / n[at]
    return np.bincount(at, weights=share * np.log(share / q), minlength=len(n))


class Pairs:
    """Counts of bytes after none and after one byte, on which every cell builds."""

    def __init__(self, counts: np.ndarray, least: float):
        self.counts, self.sums, self.root = counts, counts.sum(axis=1), counts.sum(axis=0)
        self.retained = (self.sums >= least) & (self.sums > 0)

    def probabilities(self, smoothing: float) -> np.ndarray:
        """Of a byte after a byte, or after nothing where that byte is not retained."""
        alone = (self.root + 1) / (self.root.sum() + 256)
        weight = smoothing * (self.counts > 0).sum(axis=1)[:, None]
        return np.where(self.retained[:, None], (self.counts + weight * alone) / np.maximum(1, self.sums[:, None] + weight), alone)


def branches(codes: np.ndarray, counts: np.ndarray, pairs: Pairs, depth: int, least: float, divergence: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A cell's part of the tree: ``length, contexts, n, grams, c`` of the retained contexts of two bytes and more, longest first."""
    seen = counts > 0
    grams, c = codes[seen], counts[seen]
    needed = np.zeros(0, dtype=np.int64)
    for k in range(depth, 1, -1):
        ctx = grams >> 8
        first = _firsts(ctx)
        contexts, at = ctx[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ctx)]))
        n = np.add.reduceat(c, first) if len(first) else c
        shorter = (grams >> 16) << 8 | grams & 255
        if k > 2:
            up, up_c = _merged([(shorter, c)])
            up_first = _firsts(up >> 8)
            up_n = np.repeat(np.add.reduceat(up_c, up_first), np.diff(np.r_[up_first, len(up)])) if len(up) else up_c
            where = np.searchsorted(up, shorter)
            q = up_c[where] / up_n[where]
        else:
            q = pairs.counts[shorter >> 8, shorter & 255] / pairs.sums[shorter >> 8]
        kept = (n >= least) & (_divergences(c, at, n, q) >= divergence) | np.isin(contexts, needed)
        yield k, contexts[kept], n[kept], grams[kept[at]], c[kept[at]]
        needed = np.unique(contexts[kept] >> 8)
        if k > 2:
            grams, c = up, up_c


def _found(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``asked`` are in the sorted ``values``, and which are."""
    if not len(values):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return at, values[at] == asked


def _logs(codes: np.ndarray, tree: list[tuple], own: np.ndarray, depth: int, smoothing: float) -> np.ndarray:
    """log10 probability of each gram by its longest retained suffix.

    ``tree`` is as from :func:`branches`, ``own`` has the probabilities by one byte or none.
    """
    sym = codes & 255
    p = own[codes >> 8 * depth, sym]
    for k, contexts, n, grams, c in reversed(tree):
        at, known = _found(contexts, codes >> 8 * (depth - k + 1))
        i = np.flatnonzero(known)
        if not len(i):
            break
        gram, seen = _found(grams, (codes[i] >> 8 * (depth - k + 1)) << 8 | sym[i])
        weight = smoothing * np.diff(np.r_[_firsts(grams >> 8), len(grams)])[at[i]]
        p[i] = (np.where(seen, c[gram], 0) + weight * p[i]) / (n[at[i]] + weight)
    return np.log10(p)


def _looked_up(cell: int, batches: Iterator[pa.RecordBatch], pairs: Pairs, depth: int, least: float, divergence: float, smoothing: float) -> Iterator[pa.RecordBatch]:
    """From all rows of one cell: the logarithms of each block's grams."""
    found, held = [], 0
    with tempfile.TemporaryFile() as kept:
        for batch in batches:
            for row in zip(*(batch[x].to_pylist() for x in ("block", "n", "codes", "counts")), strict=True):
                pickle.dump(row[:3], kept)
                counts = _unpacked(row[3], row[1], np.uint32).astype(np.int64)
                found.append((_from_steps(row[2], row[1])[counts > 0], counts[counts > 0]))
                held += len(found[-1][0])
                if held > HELD_GRAMS:
                    found, held = [_merged(found)], 0
        tree = list(branches(*_merged(found), pairs, depth, least, divergence))
        own, end = pairs.probabilities(smoothing), kept.tell()
        kept.seek(0)
        while kept.tell() < end:
            block, n, codes = pickle.load(kept)
            logs = _packed(_logs(_from_steps(codes, n), tree, own, depth, smoothing).astype(np.float32))
            yield pa.RecordBatch.from_pylist([{"block": block, "cell": cell, "n": n, "logs": logs}], schema=LOGS)


LOGS = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("n", pa.int64()), ("logs", pa.binary())])
SCORES = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("score", pa.float64())])


def _sums(own: np.ndarray, starts: np.ndarray, codes: np.ndarray, log: np.ndarray) -> np.ndarray:
    """Sums of the logarithms of a slice's grams ``own`` from each of ``starts`` on."""
    order = np.argsort(own)
    own = own[order]
    first = _firsts(own)
    each = np.empty(len(own))
    each[order] = np.repeat(log[np.searchsorted(codes, own[first])], np.diff(np.r_[first, len(own)]))
    return np.add.reduceat(each, starts)


def _scored(texts: pa.Table, logs: pa.Table, depth: int, cells: int) -> pa.Table:
    """log10 probability of each text of one block with its end."""
    if not texts.num_rows:
        return SCORES.empty_table()
    raw, sizes = texts["texts"][0].as_py(), texts["sizes"][0].as_py()
    found = Ranges()
    for codes, _, _ in _opened(raw, sizes, depth):
        found.add(_distinct([codes]))
        del codes
    sent = {cell.as_py(): _unpacked(x.as_buffer(), n.as_py(), np.float32) for cell, n, x in zip(logs["cell"], logs["n"], logs["logs"], strict=True)}
    own, log = [], []
    for codes in found.taken():
        own.append(codes)
        log.append(np.zeros(len(codes), dtype=np.float32))
        for cell, at in _dealt(codes, depth, cells):
            log[-1][at], sent[cell] = sent[cell][: len(at)], sent[cell][len(at) :]
    del sent
    codes, log = np.concatenate(own), np.concatenate(log)
    del own
    # slices are opened once more, as places for all bytes of a block would take more than its text
    score = np.concatenate([_sums(grams, starts, codes, log) for grams, _, starts in _opened(raw, sizes, depth)])
    block = pa.array(np.full(len(score), texts["block"][0].as_py()))
    return pa.table([block, pa.array(np.arange(len(score))), pa.array(score)], schema=SCORES)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_held_out: Column | None = None, depth: int = DEPTH, p_min: float | None = None, divergence: float = DIVERGENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows whose ``is_held_out`` is false.  Contexts of 2
    to 6 bytes (``depth``) take part from ``min_count`` occurrences on, or with
    ``p_min`` from that share of all positions on.  Null texts are empty: one
    token, the end.  Ids may be null or repeat; every row is scored by itself.
    Without any training row the base knows no token and the model is uniform.
    Other columns are not read; an empty table gives an empty result.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6: a context and its symbol are one long")
    spark = docs.sparkSession
    flag = held_out(F.col(id_col)) if is_held_out is None else is_held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), _raw(docs, text_col).alias("raw"))
    train = rows.where(~F.col("held_out"))

    totals = save(token_totals(train), "tokens")
    n_train, n_distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # at most 1 / FREQUENT tokens
    common = totals.where(F.col("c") >= FREQUENT * n_train).toPandas()
    logs = spark.sparkContext.broadcast(dict(zip(map(bytes, common["token"]), np.log10(common["c"].to_numpy(float) + 1).tolist(), strict=True)))
    # no more cells than there are pairs of bytes
    cells = min(1 << 16, max(1, -(-n_train // CELL_TOKENS)))

    saved = pa.schema(
        [("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("sizes", pa.list_(pa.list_(pa.int64()))), ("learns", pa.list_(pa.list_(pa.bool_())))]
        + [("at", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("common_known", pa.int64()), ("common_logs", pa.float64()), ("rare", pa.list_(pa.binary())), ("rare_n", pa.list_(pa.int32()))]
    )

    def batch_of(n_rows: int, **columns: list | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in saved], schema=saved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = logs.value
        block, name, n_docs = Block(depth), uuid.uuid4().int >> 65, 0
        for batch in batches:
            at = 0
            for words in _slices(_values(batch.column(2))):
                out = []
                for w in words:
                    counts = Counter(w)
                    counts[b""] = 1
                    n, n_known, total, rare = len(w) + 1, 0, 0.0, {}
                    for token, k in counts.items():
                        if (log := known.get(token)) is not None:
                            n_known += k
                            total += k * log
                        else:
                            rare[token] = k
                    out.append((n, n_known, total, list(rare), list(rare.values())))
                n, n_known, total, rare, rare_n = zip(*out, strict=True)
                part = batch.slice(at, len(words))
                at += len(words)
                block.add(words, ~part.column(1).fill_null(True).to_numpy(zero_copy_only=False))
                yield batch_of(len(words), block=[name] * len(words), at=np.arange(n_docs, n_docs + len(words)), doc_id=part.column(0), held_out=part.column(1), n_tokens=n, common_known=n_known, common_logs=total, rare=rare, rare_n=rare_n)
                n_docs += len(words)
                if block.size > BLOCK_BYTES:
                    yield batch_of(1, block=[name], **{k: [x] for k, x in block.saved().items()})
                    block, name, n_docs = Block(depth), uuid.uuid4().int >> 65, 0
        if n_docs:
            yield batch_of(1, block=[name], **{k: [x] for k, x in block.saved().items()})

    schema = "block long, pairs array<long>, counts array<long>, texts array<binary>, sizes array<array<long>>, learns array<array<boolean>>, at long, doc_id long, held_out boolean, n_tokens long, common_known long, common_logs double, rare array<binary>, rare_n array<int>"
    # saved, as the names of blocks must not change when a task runs again
    blocks = save(rows.select("doc_id", "held_out", "raw").mapInArrow(run, schema).withColumn("row_no", F.monotonically_increasing_id()), "blocks", wide=True)

    # at most 256 * 256 rows
    got = blocks.where("texts IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy("x.pairs").agg(F.sum("x.counts").alias("c")).toPandas()
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[got["pairs"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    least = min_count if p_min is None else p_min * counts.sum()
    pairs = Pairs(counts.reshape(256, 256), least)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for cell, codes, n in _listed(*parts, depth, cells):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cell]), pa.array([len(codes)]), pa.array([_steps(codes)]), pa.array([_packed(n)])], ["block", "cell", "n", "codes", "counts"])

    def looked_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _looked_up(key[0].as_py(), batches, pairs, depth, least, divergence, SMOOTHING)

    texts = blocks.where("texts IS NOT NULL").select("block", "texts", "sizes", "learns")
    grams = texts.mapInArrow(listing, "block long, cell long, n long, codes binary, counts binary")
    logs_of = grams.groupBy("cell").applyInArrow(looked_up, "block long, cell long, n long, logs binary")
    scores = texts.select("block", "texts", "sizes").groupBy("block").cogroup(logs_of.groupBy("block")).applyInArrow(lambda a, b: _scored(a, b, depth, cells), "block long, at long, score double")

    scored = blocks.where("texts IS NULL").select("row_no", "block", "at", "doc_id", "held_out", "n_tokens", "common_known", "common_logs", "rare", "rare_n")
    rare = scored.select("row_no", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row_no", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("k"))
    uncommon = totals.where(F.col("c") < FREQUENT * n_train)
    rare = rare.join(uncommon, "token").groupBy("row_no").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    found = scored.drop("rare", "rare_n").join(rare, "row_no", "left").join(scores, ["block", "at"])
    base_score = F.col("common_logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_train + n_distinct + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score"
    )


def op9_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a suffix tree learned from those not held out."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
