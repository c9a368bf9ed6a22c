"""Keyword, semantic and hybrid search over chunks.

The keyword arm asks for all lexemes of the query and ranks by cover density: a
cover is a shortest run of positions that holds all of them; it adds a tenth,
divided by one more than the foreign words in it.  The semantic arm is an exact
cosine scan.  Ranks of both are fused by reciprocal rank.  Filters stand inside
both arms, as a filter behind a rank would give other results.

Chunks are filtered by the ids of recordings alone, each arm reads only its own
columns, and titles and times are joined to the few hits at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lexemes
from ..functions.vector import cosine, literal

RRF_K = 60
POOL = 4


@dataclass(frozen=True)
class Filters:
    """Optional conditions, all of which must hold; both dates are inclusive."""

    since: str | None = None
    until: str | None = None
    speaker_id: int | None = None
    recording_id: int | None = None

    def column(self) -> Column:
        found = F.lit(True)
        if self.since is not None:
            found &= F.col("created_at") >= F.lit(self.since).cast("timestamp")
        if self.until is not None:
            found &= F.col("created_at") <= F.lit(self.until).cast("timestamp")
        if self.recording_id is not None:
            found &= F.col("recording_id") == self.recording_id
        return found


def clamped(limit: int | None, default: int, most: int) -> int:
    """Limits as the search takes them: 20 up to 200, 8 up to 50 for answers, 50 up to 500 for lists."""
    return min(max(default if limit is None else limit, 1), most)


@dataclass(frozen=True)
class Scope:
    """The chunks that pass all filters, and the recordings that have their titles."""

    chunks: DataFrame
    recordings: DataFrame


def scoped(chunks: DataFrame, recordings: DataFrame, recording_speakers: DataFrame, filters: Filters = Filters()) -> Scope:
    """Chunks whose recording is there and passes ``filters``.

    A speaker filter keeps all chunks of the recordings in which the speaker is,
    each once.
    """
    rows = chunks.join(recordings.where(filters.column()).select("recording_id"), "recording_id", "left_semi")
    if filters.speaker_id is not None:
        rows = rows.join(recording_speakers.where(F.col("speaker_id") == filters.speaker_id).select("recording_id"), "recording_id", "left_semi")
    return Scope(rows, recordings)


def keyword_scores(rows: DataFrame, query: str, analyzer: Callable[[Column], Column] = lexemes, query_lexemes: Sequence[str] | None = None) -> DataFrame:
    """``chunk_id, score`` of the chunks that hold every lexeme of the query; a query without any finds nothing."""
    terms = query_lexemes if query_lexemes is not None else rows.sparkSession.range(1).select(analyzer(F.lit(query)).alias("x")).first()["x"]
    terms = list(dict.fromkeys(terms))
    if not terms:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    tokens = rows.select("chunk_id", analyzer(F.col("text")).alias("tokens"))
    has_all = F.lit(True)
    for term in terms:
        has_all &= F.array_contains("tokens", term)
    hits = tokens.where(has_all).select("chunk_id", F.posexplode("tokens").alias("pos", "term")).where(F.col("term").isin(terms))
    return cover_density(hits, terms)


def cover_density(hits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``chunk_id, score`` from the places (chunk_id, term, pos) of all terms in chunks that hold each of them."""
    along = W.partitionBy("chunk_id").orderBy("pos")
    hits = hits.withColumn("nth", F.row_number().over(along))
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.struct("pos", "nth"))).over(upto) for t in terms]
    begin = F.least(*last) if len(last) > 1 else last[0]
    complete = F.lit(True)
    for x in last:
        complete &= x.isNotNull()
    covers = hits.select("chunk_id", "pos", "nth", begin.alias("begin"), complete.alias("complete")).where("complete")
    # of the runs with one begin the first to end is the shortest
    covers = covers.groupBy("chunk_id", "begin").agg(F.min(F.struct("pos", "nth")).alias("end"))
    noise = (F.col("end.pos") - F.col("begin.pos")) - (F.col("end.nth") - F.col("begin.nth"))
    return covers.groupBy("chunk_id").agg(F.round(F.sum(0.1 / (1 + noise)), 6).alias("score"))


def semantic_scores(rows: DataFrame, vector: list[float]) -> DataFrame:
    """``chunk_id, score``: cosine similarity; chunks without a vector are not found."""
    return rows.where("embedding IS NOT NULL").select("chunk_id", cosine(F.col("embedding"), literal(vector)).alias("score"))


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """``chunk_id, rnk`` of the best ``n``, ties to the smaller id; ranked after the cut, so no full sort."""
    return scores.orderBy(F.desc("score"), "chunk_id").limit(n).withColumn("rnk", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id"))).select("chunk_id", "rnk")


def fused(arms: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """``chunk_id, score``: sum of 1 / (k + rank) over the arms."""
    rows = arms[0]
    for arm in arms[1:]:
        rows = rows.unionByName(arm)
    return rows.groupBy("chunk_id").agg(F.sum(1.0 / (k + F.col("rnk")).cast("double")).alias("score"))


def widened(scores: DataFrame, scope: Scope, limit: int) -> DataFrame:
    """The best ``limit`` of ``scores`` with their recording, title and times."""
    top = scores.orderBy(F.desc("score"), "chunk_id").limit(limit)
    # at most `limit` rows, twice
    hits = scope.chunks.select("chunk_id", "recording_id", "start_ms", "end_ms").join(F.broadcast(top), "chunk_id")
    titled = scope.recordings.select("recording_id", "title").join(F.broadcast(hits), "recording_id")
    return titled.select("chunk_id", "recording_id", "title", "start_ms", "end_ms", F.round("score", 6).alias("score"))


def keyword_search(scope: Scope, query: str, limit: int | None = None, **options) -> DataFrame:
    return widened(keyword_scores(scope.chunks, query, **options), scope, clamped(limit, 20, 200))


def semantic_search(scope: Scope, vector: list[float], limit: int | None = None) -> DataFrame:
    """Ranked by the similarity itself; only what is returned is rounded."""
    return widened(semantic_scores(scope.chunks, vector), scope, clamped(limit, 20, 200))


def hybrid_search(scope: Scope, query: str, vector: list[float], limit: int | None = None, **options) -> DataFrame:
    """Both arms' best ``4 * limit`` (limit: 20, at most 200), fused."""
    return fused_search(scope, keyword_scores(scope.chunks, query, **options), semantic_scores(scope.chunks, vector), limit)


def fused_search(scope: Scope, keyword: DataFrame, semantic: DataFrame, limit: int | None = None) -> DataFrame:
    """Hybrid search from the scores (chunk_id, score) of two arms, which have passed the scope's filters."""
    limit = clamped(limit, 20, 200)
    return widened(fused([ranked(keyword, POOL * limit), ranked(semantic, POOL * limit)]), scope, limit)
