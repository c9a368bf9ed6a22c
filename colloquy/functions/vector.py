"""Vectors as arrays of floats; sums are kept in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lexemes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, other lengths and zero norms, null for a null vector."""
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(fits, F.try_divide(dot(a, b), size)).otherwise(0.0)


def normalised(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: (x.cast("double") / size).cast("float"))).otherwise(a)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def embedded(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """``id_col, embedding`` by a model of texts, a batch at a time, in order.

    Blank text (or null) is not sent and gives the first unit vector; a vector of
    another length than ``dim`` is an error.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            at = [i for i, x in enumerate(texts) if x is not None and x.strip()]
            out = [[1.0] + [0.0] * (dim - 1) for _ in range(len(texts))]
            for i, vector in zip(at, model([texts.iloc[i] for i in at]) if at else [], strict=True):
                if len(vector) != dim:
                    raise ValueError(f"the model gives {len(vector)} components, not {dim}")
                out[i] = vector
            yield pd.Series(out, dtype="object")

    return rows.select(id_col, embed(text_col).alias("embedding"))


def hash_embed(rows: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """``id_col, embedding``: a signed and weighted hashed bag of tokens, of length 1.

    The first 32 bits of a token's MD5 give its bucket, by the remainder, its sign,
    by the second bit, and its weight of 1 to 1.875, by the next three.  Text without
    tokens (or null) gives the first unit vector.  Tokens are summed per bucket
    before the shuffle, so a long text moves ``dim`` numbers at most.
    """
    bits = F.conv(F.left(F.md5(F.col("token").cast("binary")), F.lit(8)), 16, 10).cast("long")
    tokens = rows.select(F.col(id_col), F.explode(lexemes(F.col(text_col))).alias("token")).select(id_col, bits.alias("bits"))
    weight = 1 + F.shiftright("bits", 2).bitwiseAND(F.lit(7)) / 8
    cells = tokens.select(id_col, (F.col("bits") % dim).cast("int").alias("at"), F.when(F.shiftright("bits", 1).bitwiseAND(F.lit(1)) == 1, -weight).otherwise(weight).alias("x"))
    sums = cells.groupBy(id_col, "at").agg(F.sum("x").alias("x"))
    maps = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("cells"), F.sqrt(F.sum(F.col("x") ** 2)).alias("size"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("cells", i), F.lit(0.0)) / F.col("size")).cast("float"))
    return rows.select(id_col).join(maps, id_col, "left").select(id_col, F.when(F.coalesce(F.col("size"), F.lit(0.0)) > 0, dense).otherwise(unit).alias("embedding"))
