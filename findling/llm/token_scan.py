"""Token counts of flat token files by a separator scan.

A flat token file is nothing but ids in little-endian order, with an end-of-document id after every document and
no index. It is cut into blocks of a fixed number of ids. A task reads a block, finds all separators at once
and gives its separators and length. A document may begin in one block and end in a later one; a prefix
scan over the blocks' rows (their number of separators, and where the last stands) says for each block how
many documents have ended before it and where the open one began, and so gives exact counts without reading
any block twice. Ids after the last separator are a last document without an end.

``write_flat`` makes such files from documents. Empty files have no documents; a separator right after
another ends an empty document; null text is an empty document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import _kernel as K
from ._shared import Workspace, dealt
from .bpe import codec

#: Ids in a block, and the end-of-document id of the byte-level vocabulary.
BLOCK_IDS = 4 << 20
END_ID = 50256


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def id_width(path: str, end_id: int = END_ID) -> int:
    """Bytes of an id in a flat file: 2 if every id of the vocabulary and the end id fit, else 4."""
    return 2 if max(codec(path).ids_end, end_id + 1) <= 1 << 16 else 4


def _write(path: str, folder: str, end_id: int):
    """Writes the documents of a task as one flat file; rows (file, ids, ordinal, doc_id)."""

    def run(batches):
        bpe, width = codec(path), id_width(path, end_id)
        fs, base = _open(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.ids"
        scratch = f"{base}/.{name}.{uuid.uuid4().hex}"  # a retried task never appends to what another left
        fs.create_dir(base, recursive=True)
        held, ordinal = [], 0
        with fs.open_output_stream(scratch) as out:
            for batch, raw, at in K.steps(batches):
                ids, of = bpe.encode(raw, at, ordinary=True)
                flat = np.insert(ids, of[1:], end_id).astype(f"<u{width}")
                out.write(flat.tobytes())
                n = batch.num_rows
                held.append(([name] * n, np.arange(ordinal, ordinal + n), batch.column(batch.schema.get_field_index("doc_id"))))
                ordinal += n
        fs.move(scratch, f"{base}/{name}")
        for names, number, doc in held:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(number, pa.int64()), doc.cast(pa.int64())], ["file", "ordinal", "doc_id"])

    return run


def write_flat(docs: DataFrame, space: Workspace, path: str, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encodes documents into flat files in the shared folder: its place, and ``(file, ordinal, doc_id)``."""
    folder = f"{space.path}/flat"
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return folder, space.save(kept.mapInArrow(_write(path, folder, end_id), "file string, ordinal long, doc_id long"), "order")


def blocks(spark: SparkSession, folder: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows ``(file, block, first, n)`` of the blocks of all files of a folder, from the files' lengths."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(x.getPath().getName(), x.getLen() // width) for x in fs.listStatus(base)] if fs.exists(base) else []
    files = spark.createDataFrame([x for x in found if not x[0].startswith(".")], "file string, ids long")
    first = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(block_ids).cast("long"))
    cut = files.where("ids > 0").select("file", "ids", F.posexplode(first).alias("block", "first"))
    return cut.select("file", F.col("block").cast("long").alias("block"), "first", F.least(F.lit(block_ids), F.col("ids") - F.col("first")).cast("long").alias("n"))


def _scan(folder: str, end_id: int, width: int):
    """Separators of blocks: one row of each block (its count and last place) and one of each separator."""

    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for file, block, first, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{file}") as source:
                    source.seek(first * width)
                    flat = np.frombuffer(source.read(n * width), "<u2" if width == 2 else "<u4")
                at = np.flatnonzero(flat == end_id) + first
                before = np.concatenate(([-1], at[:-1]))  # -1: the document began before this block
                k = len(at)
                total = k + 1
                place = np.append(at, at[-1] if k else -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * total),
                        pa.array(np.full(total, block), pa.int64()),
                        pa.array([*range(k), None], pa.int64()),
                        pa.array(place, pa.int64()),
                        pa.array(np.append(before[:k], first + n), pa.int64()),
                        pa.array(np.full(total, k), pa.int64()),
                    ],
                    ["file", "block", "within", "place", "before", "found"],
                )

    return run


def count_tokens(spark: SparkSession, space: Workspace, folder: str, end_id: int = END_ID, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows ``(file, ordinal, start, n_tokens, closed)`` of every document of the flat files of a folder."""
    cut = dealt(blocks(spark, folder, width, block_ids))
    kind = "file string, block long, within long, place long, before long, found long"
    scanned = space.save(cut.mapInArrow(_scan(folder, end_id, width), kind), "scanned")
    # The prefix scan, over one row for each block.
    tops = scanned.where("within is null").select("file", "block", "found", F.when(F.col("found") > 0, F.col("place")).alias("last"), F.col("before").alias("stop"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        "file",
        "block",
        "stop",
        "found",
        "last",
        F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("ended"),
        F.coalesce(F.last("last", True).over(earlier), F.lit(-1)).alias("open"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).alias("next"),
    )
    seps = scanned.where("within is not null").join(tops.select("file", "block", "ended", "open"), ["file", "block"])
    start = F.when(F.col("within") == 0, F.col("open")).otherwise(F.col("before")) + 1
    done = seps.select("file", (F.col("ended") + F.col("within")).alias("ordinal"), start.alias("start"), (F.col("place") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    end = F.coalesce("last", "open") + 1
    rest = tops.where("next is null").where(end < F.col("stop"))
    tail = rest.select("file", (F.col("ended") + F.col("found")).alias("ordinal"), end.alias("start"), (F.col("stop") - end).alias("n_tokens"), F.lit(False).alias("closed"))
    return done.union(tail)


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens)``: flat files are written from ``docs`` and their separators scanned."""
    spark = docs.sparkSession
    space = Workspace(spark, "token-scan")
    folder, order = write_flat(docs, space, path)
    counted = count_tokens(spark, space, folder, width=id_width(path))
    return order.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens")
