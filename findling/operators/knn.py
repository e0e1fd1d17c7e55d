"""Exact nearest neighbours and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import IllegalArgument
from ..functions import ident

#: The constant of reciprocal rank fusion.
RANK_CONSTANT = 60


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Distance of an array column to a fixed vector; null where lengths differ."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    dot = total(v, q, lambda x, y: x * y)
    if metric == "cosine":
        norm = F.sqrt(total(v, v, lambda x, y: x * y)) * float(sum(x * x for x in query)) ** 0.5
        out = 1 - F.try_divide(dot, norm)
    elif metric == "l2":
        out = total(v, q, lambda x, y: (x - y) * (x - y))
    elif metric == "inner_product":
        out = 1 - dot
    else:
        raise IllegalArgument(f"unknown metric [{metric}]")
    return F.when(F.size(vector) == len(query), out)


def knn(df: DataFrame, field: str, query: list[float], k: int, where: Column | None = None, metric: str = "cosine", key: str = "_id") -> DataFrame:
    """The k nearest rows, filtered before the ranking; ties by ``key``.

    Adds ``_knn_field``, ``_knn_distance`` and ``_score`` = 1 / (1 + distance). Every task keeps k rows.
    """
    if k <= 0:
        raise IllegalArgument("[k] must be positive")
    near = (df if where is None else df.where(where)).withColumn("_knn_distance", distance(F.col(ident(field)), query, metric))
    near = near.where("_knn_distance is not null").orderBy("_knn_distance", key).limit(k)
    return near.withColumn("_knn_field", F.lit(field)).withColumn("_score", 1 / (1 + F.col("_knn_distance")))


def rrf(text: DataFrame, vector: DataFrame, key: str = "_id", text_order: str = "_score", vector_order: str = "_knn_distance") -> DataFrame:
    """Fuses two ranked lists: ``key`` and the summed reciprocal ranks, best first.

    Both lists are bounded by their request's size and k. If one is empty the other's ranks remain.
    """
    a = text.where(F.col(key).isNotNull()).select(key, F.row_number().over(Window.orderBy(F.desc(text_order), key)).alias("_rank_text"))
    b = vector.where(F.col(key).isNotNull()).select(key, F.row_number().over(Window.orderBy(vector_order, key)).alias("_rank_knn"))
    part = lambda c: F.coalesce(1 / (F.lit(RANK_CONSTANT) + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full").select(key, (part("_rank_text") + part("_rank_knn")).alias("_score")).orderBy(F.desc("_score"), key)
