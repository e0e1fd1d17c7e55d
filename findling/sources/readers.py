"""Typed columns from document JSON, and the files that indices read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import date_from_text, ident
from ..mapping import SPARK_TYPES, Mapping


def field_from_json(source: Column, name: str, kind: str) -> Column:
    """One field of a document's JSON, in its mapped type; a value of another kind is null."""
    path = "$['" + name.replace("'", "\\'") + "']"
    text = F.get_json_object(source, path)
    if kind == "knn_vector":
        return F.from_json(text, "array<float>")
    scalar = F.when(~text.rlike(r"^\s*[\[{]"), text)
    if kind == "text" or kind == "keyword":
        return scalar
    if kind == "integer":
        return F.coalesce(scalar.try_cast("bigint"), F.expr("cast(null as bigint)"), scalar.try_cast("double").try_cast("bigint"))
    if kind == "float":
        return scalar.try_cast("double")
    if kind == "boolean":
        return F.when(F.lower(scalar).isin("true", "false"), scalar.try_cast("boolean"))
    return date_from_text(scalar)


def columns_of(df: DataFrame, mapping: Mapping, source: str = "_source") -> DataFrame:
    """``_id`` and the mapped columns of rows with ``_id`` and document JSON."""
    return df.select("_id", *(field_from_json(F.col(source), n, k).alias(n) for n, k in mapping.fields.items()))


def read_source(spark: SparkSession, path: str, kind: str = "parquet", mapping: Mapping | None = None, key: str | None = None) -> DataFrame:
    """A file source as an index's rows: columns cast to the mapping, ``_id`` from ``key`` (or none)."""
    df = spark.read.json(path) if kind in ("json", "ndjson") else spark.read.format(kind).load(path)
    if mapping is not None:
        have = set(df.columns)
        df = df.select(
            *([F.col(ident(key)).cast("string").alias("_id")] if key else []),
            *(F.col(ident(n)).cast(SPARK_TYPES[k]).alias(n) if n in have else F.lit(None).cast(SPARK_TYPES[k]).alias(n) for n, k in mapping.fields.items()),
        )
    elif key:
        df = df.withColumn("_id", F.col(ident(key)).cast("string"))
    return df
