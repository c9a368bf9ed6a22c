"""Near duplicates by shingle similarity: SimHash, then an exact set-similarity join.

Texts are linked if the Jaccard similarity of their sets of word shingles is
``similarity`` or more.  Every link reported was verified on the whole sets, and
no link between different texts is lost from the components:

1. **SimHash.**  The vantage-point tree of :mod:`.simhash` gives the close
   copies, as a forest of candidates.  It cannot give all: at similarity 0.8
   fingerprints differ in 9.7 bits on average, a ball that no tree can prune.
2. **Prefixes.**  Two sets of such a similarity share a shingle among the first
   ``n - ceil(similarity * n) + 1`` of each, in any order that all texts agree on.
   Shingles are ordered by their hash, those that many texts hold last, so that a
   passage of many documents makes no long lists.
3. **Lists.**  In the list of each shingle all members are candidates with the
   first one, its lead.  What is verified joins components, so a large group of
   copies costs about as many tests as it has members.
4. **Stars.**  Texts that share a list share its lead.  Where the texts of a lead lie
   in several components, they are compared once more, in blocks of bounded size: a
   task counts what all its texts have in common by products of matrices.  First
   their prefixes tell which texts may be near one of another component, then the
   whole sets of those give the links, as a forest, never as pairs.

No two texts that share a list are left untested, unless they are in one component.
Shingles are 64-bit hashes, texts are told apart by 128 bits of their SHA-256.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import may_hold
from .simhash import Forest, components, simhash
from .simhash import links as simhash_links
from .skew import join_groups
from .store import drop, save

SIMILARITY = 0.8
SHINGLE_WORDS = 5
#: Bits in which the fingerprints of candidates of the first step differ at most.
RADIUS = 4
#: A shingle that so many texts hold is ordered last.
COMMON = 16
#: Share of a set, by hash, of which the texts that hold a shingle are counted.
COUNTED = 0.25
#: Bits of a bitmap that tasks are given: 8 MB at most.
MAP_BITS = 1 << 26
_MAP_BLOCK = 32_768
#: Partners of a text that one task gets.
LOT = 4096
#: Texts of one block of a star, two of which a task compares, and shingles that it counts at once.
BLOCK, COLUMNS = 256, 4096
#: Bytes of text whose rows are handed on at once, about.
BATCH_BYTES = 1 << 21
#: Shingles that are hashed at once.
_CHUNK = 32_768
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_rng = np.random.default_rng(5)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case, joined by single spaces; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.trim(F.regexp_replace(lower, "[\\x20\\x09-\\x0D]+", " "))


def words_digest(text: Column) -> Column:
    """The ``digest`` of a text in :func:`near_duplicates`: 16 bytes."""
    return F.unhex(F.left(F.sha2(words_of(text).cast("binary"), 256), F.lit(32)))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(joined: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all shingles of words joined by single spaces, repeats included; no words are one empty shingle.

    The hash is a polynomial in the bytes, mixed, so that all shingles of a stretch
    of text come from one running sum.
    """
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(joined)]
    width = min(width, len(starts))
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    out = np.empty(len(first), dtype=np.uint64)
    for at in range(0, len(first), _CHUNK):
        a, b = first[at : at + _CHUNK], last[at : at + _CHUNK]
        raw = np.frombuffer(joined, np.uint8, count=int(b[-1] - a[0]), offset=int(a[0]))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * _powers(len(raw), _BASE), dtype=np.uint64, out=sums[1:])
        back = _powers(len(raw) + 1, _INVERSE)[a - a[0]]
        out[at : at + _CHUNK] = _mixed((sums[b - a[0]] - sums[a - a[0]]) * back)
    return out


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set of ``n`` must be looked up."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _each_text(docs: DataFrame, text_col: str, emit: Callable[[bytes, bytes], tuple | None], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """One row of ``emit(digest, words)`` for each text, none where that is None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raws in batches:
            rows, held = [], 0
            # text by text, and handed on in small batches: a batch of texts may be large
            for raw in raws.column(0):
                joined = b" ".join((raw.as_py() or b"").lower().split())
                row = emit(hashlib.sha256(joined).digest()[:16], joined)
                if row is not None:
                    rows.append(row)
                    held += len(joined)
                if held > BATCH_BYTES:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            yield _batch(rows, names, kinds)

    return docs.select(F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def _bitmap(bits: DataFrame, n: int) -> tuple[bytes, int]:
    """A bitmap of the numbers in column ``bit``, of 8 MB at most, and its size in bits; ``n`` is how many there are."""
    size = min(MAP_BITS, max(_MAP_BLOCK, 1 << (16 * max(n, 1)).bit_length()))
    bit = F.col("bit").bitwiseAND(F.lit(size - 1))
    rows = bits.groupBy(F.floor(bit / _MAP_BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(_MAP_BLOCK))).alias("bits"))
    out = bytearray(size // 8)
    # as many rows as the bitmap has blocks
    for r in rows.collect():
        out[r["block"] * _MAP_BLOCK // 8 : (r["block"] + 1) * _MAP_BLOCK // 8] = r["bits"]
    return bytes(out), size


def _digest_bitmap(digests: DataFrame) -> tuple[bytes, int]:
    n = digests.count()
    return _bitmap(digests.select(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").alias("bit")), n)


def _holds(bitmap: bytes, size: int, digest: bytes) -> bool:
    bit = int.from_bytes(digest[:4], "big") & (size - 1)
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


class Texts:
    """The distinct word sequences of a table: each is handed to a function once."""

    def __init__(self, docs: DataFrame, text_col: str, nodes: DataFrame):
        self.docs, self.text_col, self.copies = docs, text_col, None
        repeated = nodes.where("n > 1").select("digest")
        self.bitmap, self.size = _digest_bitmap(repeated)
        if any(self.bitmap):
            bitmap, size = self.bitmap, self.size
            rows = _each_text(docs, text_col, lambda d, w: (d, w) if _holds(bitmap, size, d) else None, "digest binary, words binary", [pa.binary(), pa.binary()])
            # one copy of a text from each task
            self.copies = save(rows.groupBy("digest").agg(F.min("words").alias("words")), "copies")

    def each(self, emit: Callable[[bytes, bytes], tuple | None], schema: str, kinds: list[pa.DataType]) -> DataFrame:
        bitmap, size = self.bitmap, self.size
        if self.copies is None:
            return _each_text(self.docs, self.text_col, emit, schema, kinds)
        once = _each_text(self.docs, self.text_col, lambda d, w: None if _holds(bitmap, size, d) else emit(d, w), schema, kinds)
        return once.unionByName(_each_text(self.copies, "words", emit, schema, kinds))


def prefixes(texts: Texts, similarity: float, width: int, common: tuple[bytes, int] | None = None) -> DataFrame:
    """``digest, size, tokens, edge``: the first shingles of each set and where in the order they end; those in the bitmap ``common`` come last."""
    def emit(digest: bytes, joined: bytes) -> tuple:
        own = np.unique(shingles(joined, width))
        n, late = prefix_length(len(own), similarity), 0
        if common is None:
            n = max(n, math.ceil(len(own) * COUNTED))
        else:
            bit = (own & np.uint64(common[1] - 1)).astype(np.int64)
            shared = (np.frombuffer(common[0], np.uint8)[bit >> 3] >> (bit & 7)) & 1 == 1
            late = int(len(own) - shared.sum() < n)
            own = np.concatenate([own[~shared], own[shared]])
        return digest, len(own), own[:n].view(np.int64), (late << 62) + int(own[n - 1] >> np.uint64(2))

    return texts.each(emit, "digest binary, size long, tokens array<long>, edge long", [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()])


def _sets(texts: Texts, digests: DataFrame, width: int) -> DataFrame:
    """``digest, tokens``: the whole sets of the texts in ``digests``, and of a few others."""
    bitmap, size = _digest_bitmap(digests)
    emit = lambda d, w: (d, np.unique(shingles(w, width)).view(np.int64)) if _holds(bitmap, size, d) else None
    return save(texts.each(emit, "digest binary, tokens array<long>", [pa.binary(), pa.list_(pa.int64())]), "sets")


def _paired(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """``pairs`` (a, b; a saved table) with the columns of ``sides`` for both, as structs ``x`` and ``y``.

    The partners of a text are dealt in lots of ``LOT``, each of which gets its side.
    """
    stars = save(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("lots", F.ceil(F.col("n") / LOT)), "stars")
    dealt = join_groups(pairs, stars, ["a"], "n").withColumn("lot", F.pmod(F.xxhash64("b"), F.col("lots"))).select("a", "b", "lot")
    side = sides.select("digest", F.struct(*[c for c in sides.columns if c != "digest"]).alias("side"))
    left = side.join(stars.select(F.col("a").alias("digest"), "lots"), "digest").select(F.col("digest").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("side").alias("x"))
    return dealt.join(left, ["a", "lot"]).join(side.select(F.col("digest").alias("b"), F.col("side").alias("y")), "b")


def possible(pairs: DataFrame, prefixed: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may be so similar by what their prefixes have in common.

    What two sets share up to the end of the prefix that ends first lies in both
    prefixes; of the rest they share no more than what that set has left.  Prefixes
    are compared by 32 bits of their shingles, which can only add to what they share.
    """
    both = _paired(pairs, _short(prefixed))
    left = {k: F.col(f"{k}.size") - F.size(f"{k}.tokens") for k in "xy"}
    rest = F.when(F.col("x.edge") < F.col("y.edge"), left["x"]).when(F.col("x.edge") > F.col("y.edge"), left["y"]).otherwise(F.greatest(left["x"], left["y"]))
    # repeats of a 32-bit value count, so nothing is missed
    most = F.size("x.tokens") - F.size(F.array_except("x.tokens", "y.tokens")) + rest
    sized = both.select("a", "b", (F.col("x.size") + F.col("y.size")).alias("n"), most.alias("most"))
    return save(sized.where(F.col("most") * (1 + similarity) >= F.lit(similarity) * F.col("n") - F.lit(1e-6)).select("a", "b"), "possible")


def verified(texts: Texts, pairs: DataFrame, prefixed: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs ``a, b`` (digests; a saved table) whose whole sets are so similar."""
    near = possible(pairs, prefixed, similarity)
    sets = _sets(texts, near.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), width)
    sized = _paired(near, sets).select("a", "b", F.size("x.tokens").alias("n_a"), F.size("y.tokens").alias("n_b"), F.size(F.array_intersect("x.tokens", "y.tokens")).alias("n_both"))
    links = save(sized.where(F.col("n_both") >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - F.col("n_both"))).select("a", "b"), "verified")
    drop(near)
    drop(sets)
    return links


def _fits(similarity: float, a: str, b: str) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def _simhash_candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """``a, b``: a forest of the texts whose fingerprints are close."""
    firsts = save(nodes.groupBy("fp").agg(F.min("digest").alias("rep"), F.count("*").alias("texts")), "fingerprints")
    same = join_groups(nodes.select("fp", "digest"), firsts, ["fp"], "texts").where("digest <> rep").select(F.col("rep").alias("a"), F.col("digest").alias("b"))
    near = simhash_links(firsts.select("fp"), radius)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b")
    return same.unionByName(near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def _roots(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``digest, comp`` of every text: the number of its component."""
    ids = nodes.select("digest", "node")
    edges = links.join(ids.withColumnsRenamed({"digest": "a", "node": "u"}), "a").join(ids.withColumnsRenamed({"digest": "b", "node": "v"}), "b")
    roots = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return ids.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("comp"))


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of ``sets`` (sorted, distinct) have in common."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out


@dataclass
class Block:
    """Texts of one or two blocks of a star; ``edge`` is where the prefix of a text ends, ``size`` that of its set."""

    digests: list[bytes]
    tokens: list[np.ndarray]
    comps: np.ndarray
    blocks: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray

    def apart(self) -> np.ndarray:
        """Which pairs are this block's to compare: of two components, and of two blocks if there are two."""
        out = self.comps[:, None] != self.comps[None, :]
        return out & (self.blocks[:, None] != self.blocks[None, :]) if (self.blocks != self.blocks[0]).any() else out

    def may_link(self, similarity: float) -> list[tuple[bytes]]:
        """The texts that may be near one of another component; ``tokens`` are the low 32 bits of prefixes."""
        own = [np.unique(t) for t in self.tokens]
        # low bits that meet in one text are not to lessen what two have in common
        spare = np.array([len(t) - len(u) for t, u in zip(self.tokens, own)])
        left = self.sizes - np.array([len(t) for t in self.tokens])
        earlier = self.edges[:, None] < self.edges[None, :]
        rest = np.where(earlier, left[:, None], np.where(earlier.T, left[None, :], np.maximum(left[:, None], left[None, :])))
        most = common_shingles(own) + spare[:, None] + spare[None, :] + rest
        both = self.sizes[:, None] + self.sizes[None, :]
        near = (most * (1 + similarity) >= similarity * both - 1e-6) & (np.minimum(self.sizes[:, None], self.sizes[None, :]) >= similarity * np.maximum(self.sizes[:, None], self.sizes[None, :]) - 1e-6)
        return [(self.digests[i],) for i in np.flatnonzero((near & self.apart()).any(axis=1)).tolist()]

    def forest(self, similarity: float) -> list[tuple[bytes, bytes]]:
        """The links between components, as a forest; ``tokens`` are whole sets."""
        both = common_shingles(self.tokens)
        near = (both >= similarity * (self.sizes[:, None] + self.sizes[None, :] - both)) & self.apart()
        forest = Forest(len(self.digests))
        forest.join(*np.nonzero(np.triu(near, 1)))
        tied = np.flatnonzero(forest.parent != np.arange(len(self.digests)))
        return [(self.digests[t], self.digests[forest.parent[t]]) for t in tied.tolist()]


def _by_blocks(stars: DataFrame, sides: DataFrame, compare: Callable[[Block], list[tuple]], schema: str) -> DataFrame:
    """What ``compare`` gives for every pair of blocks of every star, each row once.

    ``stars`` has star, digest and comp, ``sides`` digest, tokens, size and edge.
    Stars of two texts, whose lead was tried with the other, and those of one
    component are left out.
    """
    stars = save(stars, "stars")
    several = stars.groupBy("star").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("n > 2 AND low <> high")
    several = save(several.select("star", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "several")
    rows = join_groups(stars, several, ["star"], "n").join(sides, "digest").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high"))))
    dealt = rows.withColumn("p", pairs).select("star", "p.low", "p.high", "block", "comp", "size", "edge", "digest", "tokens")
    dealt = dealt.repartition("star", "low", "high").sortWithinPartitions("star", "low", "high")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            found: list[tuple] = []
            if held:
                block, comp, size, edge, digests, tokens = zip(*held)
                if len(set(comp)) > 1:
                    found = compare(Block(list(digests), list(tokens), np.array(comp), np.array(block), np.array(size), np.array(edge)))
            return _batch(found, names, [pa.binary()] * len(names))

        for batch in batches:
            tokens = batch.column(8)
            flat, ends = tokens.flatten().to_numpy(), np.r_[0, np.cumsum(np.asarray(tokens.value_lengths()))].astype(np.int64)
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for i, key in enumerate(zip(*columns[:3])):
                if key != now:
                    yield done()
                    now, held = key, []
                held.append((*(c[i] for c in columns[3:]), np.sort(flat[ends[i] : ends[i + 1]])))
        yield done()

    found = save(dealt.mapInArrow(run, schema).distinct(), "compared")
    drop(stars)
    drop(several)
    return found


def _star_links(texts: Texts, members: DataFrame, lists: DataFrame, prefixed: DataFrame, similarity: float, width: int) -> DataFrame:
    """``a, b``: a forest of the links between components of texts that share a list.

    ``members`` (saved) has token, digest and comp, ``lists`` (saved) token, lead and n.
    """
    stars = save(join_groups(members, lists, ["token"], "n").select(F.col("lead.digest").alias("star"), "digest", "comp").distinct(), "leads")
    near = _by_blocks(stars, _short(prefixed), lambda b: b.may_link(similarity), "digest binary")
    sets = _sets(texts, near, width).select("digest", "tokens", F.size("tokens").alias("size"), F.lit(0).alias("edge"))
    return _by_blocks(stars.join(near, "digest", "left_semi"), sets, lambda b: b.forest(similarity), "a binary, b binary")


def _short(prefixed: DataFrame) -> DataFrame:
    """Prefixes by the low 32 bits of their shingles."""
    return prefixed.select("digest", "size", "edge", F.transform("tokens", lambda t: F.shiftright(F.shiftleft(t, 32), 32)).cast("array<int>").alias("tokens"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, digest, component_id``.

    Documents are linked if their sets of shingles have a Jaccard similarity of
    ``similarity`` or more; ``component_id`` is the smallest doc_id reachable over
    links.  ``radius`` is that of the SimHash candidates; it changes the work, not
    the result.

    Null and empty texts have no words and are one text.  Rows with a null doc_id
    link others but are never the smallest id; a component of such rows alone has a
    null component_id.  Repeated rows are returned as often as they come.  Other
    columns are not read.  An empty table gives an empty result.
    """
    width = shingle_words

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps = [], []
            for raw in batch.column(1):
                joined = b" ".join((raw.as_py() or b"").lower().split())
                digests.append(hashlib.sha256(joined).digest()[:16])
                fps.append(simhash(shingles(joined, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "digest", "fp"])

    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(marks, "doc_id long, digest binary, fp long")
    marked = save(marked, "marked")
    nodes = save(marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = Texts(docs, text_col, nodes)

    counted = prefixes(texts, similarity, width).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    counted = save(counted.select(F.col("token").alias("bit")), "common")
    prefixed = save(prefixes(texts, similarity, width, _bitmap(counted, counted.count())), "prefixes")
    entries = prefixed.select(F.explode("tokens").alias("token"), "digest", "size")
    several = save(entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "several")
    members = save(may_hold(entries, several, several.count(), "token"), "members")
    drop(several)
    lists = save(members.groupBy("token").agg(F.min(F.struct("digest", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1"), "lists")
    stars = join_groups(members, lists, ["token"], "n").where(F.col("digest") != F.col("lead.digest")).where(_fits(similarity, "size", "lead.size"))
    stars = stars.select(F.col("lead.digest").alias("a"), F.col("digest").alias("b"))
    unordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tried = save(stars.unionByName(_simhash_candidates(nodes, radius)).select(unordered).distinct(), "tried")
    first = verified(texts, tried, prefixed, similarity, width)

    placed = save(members.join(_roots(first, nodes), "digest").select("token", "digest", "comp"), "placed")
    drop(members)
    links = first.unionByName(_star_links(texts, placed, lists, prefixed, similarity, width))
    drop(placed)
    # a component's smallest id, by text
    placed = save(nodes.join(_roots(links, nodes), "digest").select("digest", "first_id", "comp", "n"), "placed")
    classes = save(placed.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("texts")), "classes")
    ids = save(join_groups(placed.select("digest", "n", "comp"), classes, ["comp"], "texts").select("digest", "component_id", "n"), "ids")
    return join_groups(marked, ids, ["digest"], "n").select("doc_id", "digest", "component_id")
