"""The job queue as pure transitions: a table of jobs in, a table of jobs out.

``now`` is always given, never read from a clock.  A micro-batch with one writer
takes the place of row locks: it applies a transition and publishes the result.
Jobs: job_id, recording_id, kind, state, priority, attempts, created_at,
run_after, locked_by, locked_at, error, payload.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .library import LIVE_STAGE, STAGES

LIVE = ("queued", "running")
LEASE_EXPIRED = "lease expired"
#: Recording numbers whose requests are numbered together.
ID_RANGE = 1 << 16
# The stages that must be done before one can run.
PREDECESSORS: dict[str, tuple[str, ...]] = {"transcode": (), "diarize": ("transcode",), "transcribe": ("transcode",), "merge": ("diarize", "transcribe"), "embed": ("merge",), "summarize": ("merge",), LIVE_STAGE: ()}


def as_jobs(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a job that they lack, null (``run_after``: their creation)."""
    missing = {"run_after": F.col("created_at"), "locked_by": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "payload": F.lit(None).cast("string")}
    return rows.withColumns({k: v for k, v in missing.items() if k not in rows.columns})


def _secs(seconds) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _changed(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Every column of ``values`` replaced where ``where`` holds (not where it is null)."""
    hit = F.coalesce(where, F.lit(False))
    return jobs.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Add requests (recording_id, kind, priority, payload) that have no live job yet.

    Of several requests for one recording and kind the highest priority counts.
    Ids go on from the largest, in order of recording (a number) and kind.
    Ranges of recordings are numbered apart, after the counts of those before.
    """
    live = jobs.where(F.col("state").isin(*LIVE)).select("recording_id", "kind")
    fresh = requests.groupBy("recording_id", "kind").agg(F.max(F.struct("priority", "payload")).alias("r")).join(live, ["recording_id", "kind"], "left_anti")
    top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0))).first()[0]
    fresh = fresh.withColumn("_range", F.floor(F.col("recording_id") / ID_RANGE))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # a row for each range
    starts = fresh.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = W.partitionBy("_range").orderBy("recording_id", "kind")
    rows = fresh.join(starts, "_range").select((F.lit(top) + F.col("_start") + F.row_number().over(order)).alias("job_id"), "recording_id", "kind", F.lit("queued").alias("state"), F.col("r.priority").alias("priority"), F.lit(0).alias("attempts"), now.alias("created_at"), now.alias("run_after"), F.col("r.payload").alias("payload"))
    return jobs.unionByName(rows, allowMissingColumns=True)


def claimable(jobs: DataFrame, kinds: Sequence[str], now: Column) -> DataFrame:
    return jobs.where((F.col("state") == "queued") & F.col("kind").isin(*kinds) & (F.col("run_after") <= now)) if kinds else jobs.limit(0)


def claim_head(jobs: DataFrame, kinds: Sequence[str], now: Column) -> DataFrame:
    """The next job: highest priority, then oldest, then smallest id.  No kinds, no job."""
    return claimable(jobs, kinds, now).orderBy(F.desc("priority"), "created_at", "job_id").limit(1)


def claim(jobs: DataFrame, worker: str, kinds: Sequence[str], now: Column) -> DataFrame:
    head = claim_head(jobs, kinds, now).select(F.col("job_id").alias("_head"))
    rows = jobs.join(F.broadcast(head), F.col("job_id") == F.col("_head"), "left")
    return _changed(rows, F.col("_head").isNotNull(), state=F.lit("running"), locked_by=F.lit(worker), locked_at=now).drop("_head")


def heartbeat(jobs: DataFrame, job_id: int, worker: str, now: Column) -> DataFrame:
    """Renew a lease; only its owner can, and only while it runs."""
    return _changed(jobs, (F.col("job_id") == job_id) & (F.col("locked_by") == worker) & (F.col("state") == "running"), locked_at=now)


def complete(jobs: DataFrame, job_ids: Iterable[int]) -> DataFrame:
    return _changed(jobs, F.col("job_id").isin(*job_ids), state=F.lit("done"), locked_by=_null("string"), locked_at=_null("timestamp"), error=_null("string"))


def fail(jobs: DataFrame, where: Column, error: str, most: int, backoff_s: float, now: Column) -> DataFrame:
    """One attempt more; queued again after ``backoff_s * 2**(attempts - 1)``, failed at ``most`` attempts."""
    n = F.col("attempts") + 1
    again = n < most
    delay = F.lit(max(float(backoff_s), 0.0)) * F.pow(F.lit(2.0), n - 1)
    return _changed(jobs, where, attempts=n, state=F.when(again, "queued").otherwise("failed"), error=F.lit(error), locked_by=_null("string"), locked_at=_null("timestamp"), run_after=F.when(again, now + _secs(delay)).otherwise(F.col("run_after")))


def defer(jobs: DataFrame, where: Column, note: str, delay_s: float, now: Column) -> DataFrame:
    """Back to the queue for later; no attempt is counted."""
    return _changed(jobs, where, state=F.lit("queued"), locked_by=_null("string"), locked_at=_null("timestamp"), error=F.lit(note), run_after=now + _secs(delay_s))


def expired(older_than_s: float, now: Column) -> Column:
    return (F.col("state") == "running") & F.col("locked_at").isNotNull() & (F.col("locked_at") < now - _secs(older_than_s))


def reap(jobs: DataFrame, older_than_s: float, most: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Take back jobs whose lease ran out: the new jobs, and ``job_id, recording_id, exhausted`` of those taken."""
    n, gone = F.col("attempts") + 1, expired(older_than_s, now)
    state = F.when(n >= most, "failed").otherwise("queued")
    taken = jobs.where(gone).select("job_id", "recording_id", (n >= most).alias("exhausted"))
    return _changed(jobs, gone, state=state, attempts=n, error=F.lit(LEASE_EXPIRED), locked_by=_null("string"), locked_at=_null("timestamp")), taken


def backlog(jobs: DataFrame) -> DataFrame:
    """One row: jobs queued, running, failed; recordings that wait for a stage that the schedule holds back."""
    waiting = F.when((F.col("state") == "queued") & F.col("kind").isin(*STAGES), F.col("recording_id"))
    return jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "failed")], F.countDistinct(waiting).alias("recordings_waiting"))


def stages_done(jobs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``recording_id`` of the recordings for which all of ``kinds`` are done; without kinds, of all."""
    if not kinds:
        return jobs.select("recording_id").distinct()
    done = jobs.where((F.col("state") == "done") & F.col("kind").isin(*kinds))
    return done.groupBy("recording_id").agg(F.countDistinct("kind").alias("n")).where(F.col("n") == len(set(kinds))).select("recording_id")


def may_start(jobs: DataFrame, kind: str) -> DataFrame:
    return stages_done(jobs, PREDECESSORS[kind])


def ready(jobs: DataFrame) -> DataFrame:
    return stages_done(jobs, ("embed", "summarize"))


def due_successors(jobs: DataFrame, after: str) -> DataFrame:
    """``recording_id, kind``: stages to enqueue once ``after`` is done, where all they need is done."""
    out = None
    for kind, needs in PREDECESSORS.items():
        if after in needs:
            part = may_start(jobs, kind).select("recording_id", F.lit(kind).alias("kind"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else jobs.select("recording_id", "kind").limit(0)


def claimable_kinds(kinds: Sequence[str], allowed: bool) -> list[str]:
    """While the schedule holds work back only the live stage may be claimed."""
    return list(kinds) if allowed else [k for k in kinds if k == LIVE_STAGE]
