"""Aggregations of a search request over the matching rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParsingError
from ..functions import ident
from ..mapping import Mapping

METRICS = ("min", "max", "avg", "sum", "value_count", "stats")


def _metric(kind: str, spec: dict, mapping: Mapping, df: DataFrame) -> DataFrame:
    name = spec.get("field", "")
    if name not in df.columns:
        empty = {"sum": "0D", "value_count": "0L"}.get(kind, "cast(null as double)")
        if kind == "stats":
            return df.agg(F.lit(0).cast("long").alias("count"), *(F.lit(None).cast("double").alias(k) for k in ("min", "max", "avg")), F.lit(0.0).alias("sum"))
        return df.agg(F.expr(f"first({empty})").alias("value")) if kind not in ("sum", "value_count") else df.agg(F.expr(empty).alias("value"))
    column = F.col(ident(name))
    number = column if mapping.kind(name) == "date" else column.cast("double")
    if mapping.kind(name) == "date":
        number = F.unix_millis(column.cast("timestamp")).cast("double")
    if kind == "value_count":
        return df.agg(F.count(column).alias("value"))
    total = F.coalesce(F.sum(number), F.lit(0.0))
    if kind == "stats":
        return df.agg(F.count(number).alias("count"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("avg"), total.alias("sum"))
    return df.agg({"min": F.min(number), "max": F.max(number), "avg": F.avg(number), "sum": total}[kind].alias("value"))


def aggregate(df: DataFrame, aggs: dict, mapping: Mapping) -> dict[str, DataFrame]:
    """A DataFrame for each named aggregation: ``value`` or the statistics in one row, or ``key, doc_count`` buckets."""
    out = {}
    for name, body in aggs.items():
        if not isinstance(body, dict) or not body:
            raise ParsingError(f"aggregation [{name}] needs an object")
        kind, spec = next(iter(body.items()))
        if kind in METRICS:
            out[name] = _metric(kind, spec, mapping, df)
        elif kind == "terms":
            column = F.col(ident(spec["field"]))
            # The limit is the feature: the size largest buckets, ties by key.
            buckets = df.where(column.isNotNull()).groupBy(column.alias("key")).agg(F.count("*").alias("doc_count"))
            out[name] = buckets.orderBy(F.desc("doc_count"), F.asc("key")).limit(int(spec.get("size", 10)))
        elif kind == "histogram":
            step = float(spec["interval"])
            if step <= 0:
                raise ParsingError("[interval] must be positive")
            column = F.col(ident(spec["field"])).cast("double")
            key = (F.floor(column / step) * step).cast("double")
            out[name] = df.where(column.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("doc_count")).orderBy("key")
        else:
            raise ParsingError(f"unknown aggregation [{kind}]")
    return out
