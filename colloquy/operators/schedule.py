"""Weekly processing windows: which are open, and when that changes.

Days: day (0 is Monday), enabled, start_min, end_min.  A window is half open; one
that ends where or before it starts runs past midnight, and equal bounds mean 24
hours.  Times are local wall-clock times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import merged

DAY_MIN = 1440
LOOKAHEAD = 8


def normalised(days: DataFrame) -> DataFrame:
    """Exactly seven days, bounds within a day; days that are missing are off."""
    week = days.sparkSession.range(7).select(F.col("id").cast("int").alias("day"))
    rows = week.join(days.where("day BETWEEN 0 AND 6"), "day", "left")
    edge = lambda c, other: F.least(F.greatest(F.coalesce(c, F.lit(other)), F.lit(0)), F.lit(DAY_MIN))
    return rows.select("day", F.coalesce("enabled", F.lit(False)).alias("enabled"), edge(F.col("start_min"), 540).alias("start_min"), edge(F.col("end_min"), 1020).alias("end_min"))


def window_minutes() -> Column:
    return F.when(F.col("end_min") > F.col("start_min"), F.col("end_min") - F.col("start_min")).otherwise(DAY_MIN - F.col("start_min") + F.col("end_min"))


def open_windows(days: DataFrame, now: DataFrame) -> DataFrame:
    """``now_at, start, end``: merged windows from the day before each ``now_at`` to eight days on."""
    dates = now.select("now_at", F.explode(F.sequence(F.date_sub(F.to_date("now_at"), 1), F.date_add(F.to_date("now_at"), LOOKAHEAD - 1))).alias("date"))
    dates = dates.withColumn("day", F.weekday("date"))
    # seven rows
    rows = dates.join(F.broadcast(days.where("enabled")), "day")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
    start = F.col("date").cast("timestamp") + minutes(F.col("start_min"))
    return merged(rows.select("now_at", start.alias("start"), (start + minutes(window_minutes())).alias("end")), ["now_at"])


def decisions(days: DataFrame, now: DataFrame, enabled: bool = True, override: str | None = None, until: str | None = None) -> DataFrame:
    """``now_at, allowed, reason, next_change_secs`` for each ``now_at``.

    A live override (``run`` or ``pause``) counts before a schedule that is off,
    and that before the windows.
    """
    t = F.col("now_at")
    secs = lambda a, b: F.greatest(F.unix_timestamp(b) - F.unix_timestamp(a), F.lit(0))
    found = now.select("now_at").distinct().join(open_windows(days, now), "now_at", "left").groupBy("now_at").agg(
        F.min(F.when((F.col("start") <= t) & (t < F.col("end")), F.col("end"))).alias("closes"), F.min(F.when(F.col("start") > t, F.col("start"))).alias("opens")
    )
    allowed, reason, change = F.col("closes").isNotNull(), F.when(F.col("closes").isNotNull(), "in_window").otherwise("outside_window"), F.when(F.col("closes").isNotNull(), secs(t, F.col("closes"))).otherwise(secs(t, F.col("opens")))
    change = F.when(F.coalesce("closes", "opens").isNotNull(), change)
    if not enabled:
        allowed, reason, change = F.lit(True), F.lit("disabled"), F.lit(None).cast("long")
    if override is not None:
        live = F.lit(until).cast("timestamp") > t
        allowed = F.when(live, override == "run").otherwise(allowed)
        reason = F.when(live, f"override_{override}").otherwise(reason)
        change = F.when(live, secs(t, F.lit(until).cast("timestamp"))).otherwise(change)
    return found.select("now_at", allowed.alias("allowed"), reason.alias("reason"), change.cast("long").alias("next_change_secs"))


def retry_delay(next_change_secs: Column) -> Column:
    """Seconds until a stage that the window's end cut off is tried again: a minute at least, an hour if unknown."""
    return F.greatest(F.coalesce(next_change_secs, F.lit(3600)), F.lit(60))


def checked_days(days: list[dict]) -> list[dict]:
    """Seven days with bounds within a day, or ``ValueError``."""
    if len(days) != 7 or any(not 0 <= d[k] <= DAY_MIN for d in days for k in ("start_min", "end_min")):
        raise ValueError("a schedule has seven days with bounds of 0 to 1440 minutes")
    return days


def checked_override(minutes: int) -> int:
    """The length of an override, or ``ValueError``."""
    if not 1 <= minutes <= DAY_MIN:
        raise ValueError("an override lasts 1 to 1440 minutes")
    return minutes
