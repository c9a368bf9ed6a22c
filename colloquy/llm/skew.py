"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are fewer than 1024 such keys.
HOT_SHARE = 1 / 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, which has a row for each key; nulls are equal.

    ``weight`` is a column of ``groups``: how many rows have that key.  Keys that
    hold more than ``HOT_SHARE`` of them, fewer than 1024 by that very bound, are
    broadcast, so their rows stay where they are; all other keys are joined by a
    shuffle in which no key is large.  ``how`` is ``inner`` or ``left``.  Both
    sides are read more than once and should be saved tables; ``weight`` is not
    returned.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    named = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    hot = named.where(F.col(weight) > F.lit(total * HOT_SHARE)).drop(weight)
    cold = named.where(F.col(weight) <= F.lit(total * HOT_SHARE)).drop(weight)

    def same(left: DataFrame, right: DataFrame) -> Column:
        return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])

    few = hot.select(*[f"_{k}" for k in keys])
    rest = rows.join(F.broadcast(few), same(rows, few), "left_anti")
    out = [c for c in (*rows.columns, *groups.columns) if c != weight]
    out = list(dict.fromkeys(out))
    return rows.join(F.broadcast(hot), same(rows, hot)).select(*out).unionByName(rest.join(cold, same(rest, cold), how).select(*out))
