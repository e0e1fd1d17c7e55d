"""Results as Arrow IPC streams and NDJSON, partition by partition."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def to_ipc(df: DataFrame) -> bytes:
    """A (bounded) result as one Arrow IPC stream."""
    table, out = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    """The DataFrame of an Arrow IPC stream."""
    return spark.createDataFrame(pa.ipc.open_stream(io.BytesIO(data)).read_all())


def to_ndjson(df: DataFrame, rows_in_frame: int = 1000) -> Iterator[str]:
    """A frame of metadata, then frames of rows; only one partition at a time is on the driver."""
    yield json.dumps({"type": "meta", "columns": df.columns})
    held: list[list] = []
    for row in df.toJSON().toLocalIterator():
        held.append(list(json.loads(row).get(c) for c in df.columns))
        if len(held) == rows_in_frame:
            yield json.dumps({"type": "rows", "rows": held})
            held = []
    if held:
        yield json.dumps({"type": "rows", "rows": held})
