"""Best-fit packing of documents into sequences, with certified bin counts and repacking.

A document is its token ids and a closing id. Only one that is longer than a sequence is cut, so that all
its pieces but the first are full. Full pieces are sequences by themselves. The others are dealt to
partitions and packed by best-fit decreasing. Dual-feasible functions map lengths so that every packing
stays feasible, so their sums bound the bins that any packing needs; the best of them certifies a
partition's count: no run over the same documents can need fewer. What is left to gain lies between partitions, since
what one's long documents leave empty may suit another's short ones; so a partition gives up its loosest bins, as many as the
gap to the plain sum of its lengths can use, and never more than ``PART_ITEMS / FAN_IN`` documents (or one bin). One whose lengths
fill its bins up is closed but for its loosest bin. Groups of ``FAN_IN`` partitions exchange these and best-fit decreasing
runs again over them, round after round until one partition is left. So a partition never holds more than ``PART_ITEMS``
documents on average, in whatever round. A repacking that needs no fewer bins is not taken. Bounds depend only on counts by length (at most ``capacity`` of them).

Null text is an empty document of the closing id alone. Rows with one id are packed as separate documents.
Extra columns are not read. Ties go by row number, so a packing repeats exactly for the same table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import Workspace
from .bpe import codec

CAPACITY = 2048
CLOSING_ID = 0
#: Documents that one partition packs on average, and how many partitions exchange documents in a round.
PART_ITEMS = 8192
FAN_IN = 32
#: Bins that a partition gives up for each bin of its gap.
GIVEN_UP = 6


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The fewest bins for ``counts[x]`` items of each length ``x``, by the best dual-feasible function."""
    x = np.arange(len(counts), dtype=np.int64)
    best = -(-int((x * counts).sum()) // capacity)
    # Items above capacity - cut fill a bin; those below cut count nothing.
    for cut in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - cut, capacity, np.where(x >= cut, x, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    # Rounding down to multiples of 1 / k; lengths that are a multiple of 1 / (k + 1) stay as they are.
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, k * x, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, in the fullest bin that still takes it, longest items first."""
    order = np.argsort(-length, kind="stable")
    bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0  # the bits of open_rooms name the rooms that some bin has
    for i, x in zip(order.tolist(), length[order].tolist(), strict=True):
        fit = open_rooms >> x
        if fit:
            left = x + (fit & -fit).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, own = capacity, count
            count += 1
        bins[i], offset[i] = own, capacity - left
        left -= x
        if left:
            room[left].append(own)
            open_rooms |= 1 << left
    return bins, offset, count


def _pieces(path: str, capacity: int, closing: int):
    def run(batches):
        bpe = codec(path)
        for batch, raw, at in K.steps(batches):
            ids, of = bpe.encode(raw, at)
            doc, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(closing)).astype("<u4")
                first = (len(own) - 1) % capacity + 1
                edges = [0, *range(first, len(own) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    doc.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(own[lo:hi]))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pack(capacity: int, turn: int):
    def run(keys, table):
        row, length, was, was_at = (table.column(c).to_numpy() for c in ("row", "length", "bin", "offset"))
        part = keys[0].as_py()
        order = np.argsort(row)
        row, length, was, was_at = row[order], length[order], was[order], was_at[order]
        bins, offset, count = best_fit_decreasing(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        before = len(np.unique(was)) if turn else count + 1
        if count >= before:
            names, bins = np.unique(was, return_inverse=True)
            count, offset = before, was_at
        else:
            names = (np.int64(turn) << 56) | (np.int64(part) << 28) | np.arange(count)
        fill, held = np.bincount(bins, length, count), np.bincount(bins, minlength=count)
        gap = count - -(-int(length.sum()) // capacity)
        order = np.argsort(fill, kind="stable")[: GIVEN_UP * gap + 1]
        loose = np.zeros(count, bool)
        loose[order[np.cumsum(held[order]) <= max(PART_ITEMS // FAN_IN, held[order[0]])]] = True
        return pa.table(
            {
                "row": pa.array(row),
                "length": pa.array(length),
                "bin": pa.array(names[bins]),
                "offset": pa.array(offset),
                "loose": pa.array(loose[bins]),
                "part": pa.array(np.full(len(row), part // FAN_IN)),
                "bins": pa.array(np.full(len(row), count)),
                "bound": pa.array(np.full(len(row), bound)),
            }
        )

    return run


def pack(items: DataFrame, space: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Places ``items (row, length)``: rows ``(row, bin, offset)``; lengths are 1 to ``capacity``."""
    full = items.where(F.col("length") == capacity).select("row", (F.lit(1 << 62) + F.col("row")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    short = items.where(F.col("length") < capacity).select("row", "length")
    parts = max(1, -(-short.count() // PART_ITEMS))
    dealt = short.select("row", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    kind = "row long, length long, bin long, offset long, loose boolean, part long, bins long, bound long"
    placed, turn = full, 0
    while True:
        packed = space.save(dealt.groupBy("part").applyInArrow(_pack(capacity, turn), kind), f"packed-{turn}")
        if parts == 1:
            return placed.union(packed.select("row", "bin", "offset"))
        placed = placed.union(packed.where("not loose").select("row", "bin", "offset"))
        dealt = packed.where("loose").select("row", "length", "bin", "offset", "part")
        if dealt.isEmpty():  # every partition is certified
            return placed
        parts, turn = -(-parts // FAN_IN), turn + 1


def certificate(items: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """The bins of a packing and the fewest that any packing needs, from counts by length."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().toLocalIterator():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    return placed.select("bin").distinct().count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one for each piece."""
    space = Workspace(docs.sparkSession, "packing")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = kept.mapInArrow(_pieces(path, capacity, closing), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = space.save(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("row", "length"), space, capacity)
    return pieces.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
