"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DimensionError(ValueError):
    """A vector of other dimensions than the index."""


def cosine_distance(a: Column, b: Column | Sequence[float]) -> Column:
    """1 - cosine similarity in double precision; null where either vector has no length."""
    if not isinstance(b, Column):
        return _to_constant(a, [float(x) for x in b])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _to_constant(a: Column, query: list[float]) -> Column:
    """The query's norm is a constant; one pass over the vector sums dot product and norm."""
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(x) for x in query])
    pairs = F.zip_with(a, q, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    sums = F.aggregate(pairs, start, lambda s, p: F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["n"] + p["x"] * p["x"]).alias("n")))
    return F.lit(1.0) - F.try_divide(sums["d"], F.sqrt(sums["n"]) * F.lit(norm))


def with_dimensions(vectors: DataFrame, dims: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dims`` components; missing and other vectors are passed over."""
    return vectors.where(F.size(vector_col) == dims)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """The ``k`` nearest (id, distance) by (distance, id): partial top-k in each task, one merge."""
    if dims is not None and len(query) != dims:
        raise DimensionError(f"query has {len(query)} dimensions, the index {dims}")
    ranked = with_dimensions(vectors, len(query), vector_col).select(F.col(id_col), cosine_distance(F.col(vector_col), query).alias("distance"))
    return ranked.orderBy(F.col("distance").asc_nulls_last(), F.col(id_col)).limit(max(k, 0))


def nearest_documents(docs: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """The nearest documents with all their columns and the distance, nearest first."""
    found = nearest(docs, query, k, id_col, vector_col, dims)
    return docs.join(F.broadcast(found), id_col).orderBy(F.col("distance").asc_nulls_last(), F.col(id_col))  # k rows
