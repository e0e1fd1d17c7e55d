"""Set similarity self-join on word shingles through parity sketches.

Method. A document's set is its distinct shingles of five words. A *parity sketch* hashes every shingle
to one bit and flips it, so the Hamming distance of two sketches never exceeds the size of the symmetric
difference of the sets. Sets of ``s <= l`` shingles with Jaccard similarity of at least ``t`` differ in
at most ``D = floor(s * (1 - t) / t)`` shingles. Sizes fall into bands ``[2**c, 2**(c + 1))`` of the
smaller set; the sketches of a band are cut into more pieces than ``D``, so (pigeonhole) equal pieces must
exist, and among the pieces of each sketch, in an order common to all, two of the first ``D + 1`` coincide.
A piece is 65,536 bits wide and is kept as the XOR of a code for each set bit, which is the same for two
pieces exactly if their bits are (up to 64-bit hash collisions). The order puts the pieces first that few
sketches share (counted over all sketches in ``COUNTERS`` hashed counters) and pieces without a set bit last, so
that passages which very many documents contain cause few candidates.

1. One pass measures the sets and counts the pieces; 2. a second pass emits the first ``D + 1`` of every sketch, packed in
binary blocks for ranges of piece hashes; 3. each range finds the pieces that several different sets share.
A small group gives all its pairs; larger groups with one least member become one group. 4. Large groups are
dealt to blocks of bounded size. A block compares its members with one another and with a few pivots of
the group, by sizes, by parity sketches and then exactly, and gives no more links than join its components (a
forest). 5. Groups that still hold several components are compared across blocks, the members outside
the group's largest component with all others, again as forests. So rows stay in proportion to members, and
only the comparisons inside a task grow with the square of a block. 6. Pairs of small groups that sizes and short sketches
(four bits a shingle) don't rule out are verified on the whole sets, for each set its nearest partner first and then the
pairs that still join two components. No link that joins components is lost. Equal sets are one set from step 3 on.

``sketch_links`` and ``link_counts`` give the links themselves: all pairs of step 3 and of all blocks are verified, inside
components too, so their rows and work grow with the number of links.

Words are hashed with 64 bits, eight bytes at a time; a set's identity has 128 bits. Null and blank texts have the
empty set, link to nothing and are components of their own. Rows with the same id are documents of their own;
``component_id`` is the least id among a component's rows. A null id counts as the least and comes out as null. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import _kernel as K
from ._shared import Workspace, components, relabelled, spread

#: Words in a shingle, and the similarity (numerator over 100) from which two sets link.
SHINGLE_WORDS = 5
MIN_SIMILARITY = 75
#: Hashed counters that order the pieces, in chunks that travel together; tasks whose counts are summed at a time.
COUNTERS = 1 << 22
CHUNKS = 64
FAN_IN = 64
#: Least and most bits of a short sketch (about four for each shingle), and the size up to which a group gives all pairs.
SKETCH_BITS = (256, 1 << 16)
ALL_PAIRS = 6
#: Members, and shingles of all members, of one block of a large group; members of each group that visit every block.
GROUP_BLOCK = 1024
BLOCK_SHINGLES = 1 << 22
PIVOTS = 4
#: What stands for a null id inside.
NO_ID = -(1 << 63)

_U = np.uint64
_SHIFT = _U(64 - 22)  # the top bits of a signature are its counter
_STEP = (np.arange(1, 64, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, ASCII letters lower-cased.

    A text with fewer words than ``width`` has one shingle of all its words; one without words has none.
    """
    raw = K.LOWER[raw]
    start, end, first = K.words(raw, at)
    word = K.span_hash(raw, start, end)
    total = max(0, len(word) - width + 1)
    joined = np.zeros(total, _U)
    for j in range(width):
        joined += word[j : j + total] * _STEP[j]
    joined = K.mix(joined)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(joined[lo : hi - width + 1]))
        elif hi > lo:
            out.append(K.mix(np.array([int((word[lo:hi] * _STEP[: hi - lo]).sum(dtype=_U)) ^ (hi - lo)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def allowed(n: int, similarity: int = MIN_SIMILARITY) -> int:
    """The largest symmetric difference of a linked pair whose smaller set has ``n`` members."""
    return n * (100 - similarity) // similarity


def bands(n: int, similarity: int = MIN_SIMILARITY) -> list[tuple[int, int, int]]:
    """The size bands of a set of ``n``: (band, pieces of a sketch, pieces to emit).

    A set belongs to the band of its size, and to the one below if a smaller set there may link to it. Large
    sets have one to two shingles a piece; small ones mostly one, so that hardly a piece is cancelled.
    """
    out = []
    own = n.bit_length() - 1
    for c in (own, own - 1):
        top = 2 ** (c + 1) - 1  # the largest size of the smaller set
        if c >= 0 and (c == own or top * 100 >= n * similarity):
            d = allowed(min(n, top), similarity)
            if d:
                out.append((c, (top + 1) // 2 if top > 100 else 4 * (top + 1), d + 1))
    return out


def pieces(hashes: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of a parity sketch that have an odd bit: signatures, whether it is but one bit, and places."""
    piece = ((hashes >> _U(32)) * _U(count)) >> _U(32)
    code = K.mix((hashes & _U(0xFFFF)) + _U(0x51ED2701))
    new = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    value = np.bitwise_xor.reduceat(code, new)
    single = np.logical_or.reduceat(code == np.repeat(value, np.diff(np.append(new, len(code)))), new)
    odd = value != 0
    return K.mix(value[odd] ^ K.mix(piece[new][odd] * _U(64) + _U(band))), single[odd], piece[new][odd]


def first_pieces(hashes: np.ndarray, band: int, count: int, emit: int, rank: np.ndarray) -> np.ndarray:
    """The first ``emit`` signatures in the common order: rarely counted ones, one bit counting as twice as common
    as several (texts often share a stray shingle); then by hash; pieces of zeros last."""
    own, single, place = pieces(hashes, band, count)
    if len(own) > emit:
        order = np.lexsort((own, rank[(own >> _SHIFT).astype(np.int64)].astype(np.int64) + 8 * single))
        own = own[order[:emit]]
    elif len(own) < emit:  # very rare: odd bits that cancelled
        zero = np.setdiff1d(np.arange(count, dtype=_U), place)[: emit - len(own)]
        own = np.concatenate((own, K.mix(K.mix(zero * _U(64) + _U(band)))))
    return own


def short_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits; a longer one folds to a shorter one by XOR of its halves."""
    bits = min(max(SKETCH_BITS[0], 1 << (4 * len(hashes) - 1).bit_length()), SKETCH_BITS[1])
    odd = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of words) brought down to ``size`` words."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def set_key(hashes: np.ndarray) -> bytes:
    """A set's identity."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def set_id(key: bytes) -> int:
    """Half of the identity, which stands for the set in piece blocks; sets that share it are told apart later."""
    return int.from_bytes(key[:8], "little", signed=True)


def _measure(batches):
    """One row for each document, and the counters of the pieces that this task saw."""
    seen = np.zeros(COUNTERS, np.int32)
    names = ["doc_id", "version", "n_shingles", "set_key", "set_id", "sketch", "task", "chunk", "counts"]
    for batch, raw, at in K.steps(batches):
        sets = shingle_hashes(raw, at)
        got = [pieces(h, c, count)[0] >> _SHIFT for h in sets for c, count, _ in bands(len(h)) if len(h)]
        if got:
            at_, n = np.unique(np.concatenate(got), return_counts=True)
            seen[at_.astype(np.int64)] += n.astype(np.int32)
        keys = [set_key(h) if len(h) else None for h in sets]
        columns = [
            *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "version")),
            pa.array([len(h) for h in sets], pa.int64()),
            pa.array(keys, pa.binary()),
            pa.array([None if k is None else set_id(k) for k in keys], pa.int64()),
            pa.array([short_sketch(h) if len(h) else None for h in sets], pa.binary()),
            *(pa.nulls(len(sets), kind) for kind in (pa.int64(), pa.int32(), pa.binary())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
    none = [pa.nulls(CHUNKS, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())]
    chunks = [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in np.split(seen, CHUNKS)]
    task = pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int64())
    yield pa.RecordBatch.from_arrays([*none, task, pa.array(range(CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], names)


def _add(keys, table):
    """Sums the counters of one chunk over some tasks."""
    kind = np.uint16
    total = np.zeros(COUNTERS // CHUNKS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), kind)
    # The order needs no more than the logarithm, so sums saturate rather than widen.
    return pa.table({"task": pa.array([keys[1].as_py()], pa.int64()), "chunk": pa.array([keys[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 65535).astype(kind).tobytes()], pa.binary())})


def _emit(sent, ranges: int):
    """Blocks of the first pieces and their sets, one for each range of piece hashes at a time."""
    width = -(-(1 << 64) // ranges)

    def run(batches):
        rank = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            sig, sid = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(sig)
            sig, sid = sig[order], sid[order]
            cut = np.searchsorted(sig, np.array([min(k * width, (1 << 64) - 1) for k in range(1, ranges)], _U))
            edge = np.concatenate(([0], cut, [len(sig)]))
            own = [k for k in range(ranges) if edge[k] < edge[k + 1]]
            blocks = [sig[edge[k] : edge[k + 1]].tobytes() + sid[edge[k] : edge[k + 1]].tobytes() for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blocks, pa.binary())], ["range", "block"])

        for _, raw, at in K.steps(batches):
            for h in shingle_hashes(raw, at):
                if not len(h):
                    continue
                own = set_id(set_key(h))
                for c, count, emit in bands(len(h)):
                    sig = first_pieces(h, c, count, emit, rank)
                    held.append((sig, np.full(len(sig), own, np.int64)))
                    size += len(sig)
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _groups(keys, table):
    """Pairs and large groups of the sets that share a piece, for one range of pieces."""
    sig, sid = [], []
    for block in table.column("block").to_pylist():
        half = len(block) // 2
        sig.append(np.frombuffer(block[:half], _U))
        sid.append(np.frombuffer(block[half:], np.int64))
    sig, sid = np.concatenate(sig), np.concatenate(sid)
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
    sig, sid = sig[keep], sid[keep]
    lo = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(lo, len(sig)))
    a, b, large = [], [], set()
    for k in range(2, ALL_PAIRS + 1):
        at = lo[size == k]
        for i in range(k):
            for j in range(i + 1, k):
                a.append(sid[at + i])
                b.append(sid[at + j])
    for at, n in zip(lo[size > ALL_PAIRS].tolist(), size[size > ALL_PAIRS].tolist(), strict=True):
        large.add(sid[at : at + n].tobytes())
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0) if a else np.zeros((0, 2), np.int64)
    groups = sorted(large)
    return pa.table(
        {
            "a": pa.array([*pairs[:, 0].tolist(), *[None] * len(groups)], pa.int64()),
            "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(groups)], pa.int64()),
            "members": pa.array([*[None] * len(pairs), *groups], pa.binary()),
        }
    )


def _spell_out(batches):
    """Members of large groups as rows. Groups with one least member go together: near copies share most of their
    pieces, and so their pairs are looked at once and not once for each piece."""
    for batch in batches:
        for members in batch.column(0).to_pylist():
            own = np.frombuffer(members, np.int64)
            pivot = np.arange(len(own)) < PIVOTS
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), own[0])), pa.array(own), pa.array(pivot)], ["grp", "set_id", "pivot"])


class _Compared:
    """The sets of one task, told apart by sizes, by parity sketches and then exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.first = np.cumsum(self.n) - self.n
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int64)
        bits = min(max(SKETCH_BITS[0], 1 << (4 * int(self.n.max()) - 1).bit_length()), SKETCH_BITS[1])
        odd = np.zeros((len(sets), bits), np.uint8)
        for i, x in enumerate(sets):
            odd[i] = np.bincount((x & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        self.sketch = np.packbits(odd, axis=1).view(np.uint64)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link to i."""
        least, most = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
        others = others[least * 100 >= most * MIN_SIMILARITY]
        # The symmetric difference of a linked pair, by the sizes of both.
        limit = (self.n[others] + self.n[i]) * (100 - MIN_SIMILARITY) // (100 + MIN_SIMILARITY)
        others = others[np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(1) <= limit]
        if not len(others):
            return others
        own = self.flat[self.first[i] : self.first[i] + self.n[i]]
        self.mark[own] = 1
        size = self.n[others]
        ends = np.cumsum(size)
        both = np.add.reduceat(self.mark[self.flat[np.repeat(self.first[others] - (ends - size), size) + np.arange(ends[-1])]], ends - size)
        self.mark[own] = 0
        return others[100 * both >= MIN_SIMILARITY * (size + self.n[i] - both)]


def _rows(table, extra: list[str]):
    """Nodes, their sets and further columns of a group's rows, each (node, role) once."""
    node, driver = table.column("node").to_numpy(), table.column("driver").to_numpy(zero_copy_only=False)
    _, at = np.unique(np.stack((node, driver.astype(np.int64))), axis=1, return_index=True)
    hashes = table.column("hashes").combine_chunks()
    return node[at], driver[at], [np.frombuffer(hashes[i].as_buffer(), _U) for i in at.tolist()], [table.column(c).to_numpy()[at] for c in extra]


def _forest(keys, table):
    """Links that join the components of the members of one block."""
    node, _, sets, _ = _rows(table, [])
    got, label = _Compared(sets), np.arange(len(node))
    fresh = np.ones(len(node), bool)  # not yet compared with all others
    a, b, todo = [], [], []
    for start in range(len(node)):
        todo.append(start)
        while todo:  # from link to link, so that large components close early
            i = todo.pop()
            if not fresh[i]:
                continue
            fresh[i] = False
            for j in got.linked(i, np.flatnonzero(fresh & (label != label[i]))).tolist():
                if label[j] != label[i]:
                    a.append(i)
                    b.append(j)
                    label[label == label[j]] = label[i]
                    todo.append(j)
    return pa.table({"a": pa.array(node[a], pa.int64()) if a else pa.array([], pa.int64()), "b": pa.array(node[b], pa.int64()) if b else pa.array([], pa.int64())})


def _across(keys, table):
    """Links that join components between some members of a group and a block of all its members."""
    node, driver, sets, (component,) = _rows(table, ["component"])
    got = _Compared(sets)
    _, label = np.unique(component, return_inverse=True)
    a, b = [], []
    for i in np.flatnonzero(driver).tolist():
        for j in got.linked(i, np.flatnonzero(~driver & (label != label[i]))).tolist():
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array(node[a], pa.int64()) if a else pa.array([], pa.int64()), "b": pa.array(node[b], pa.int64()) if b else pa.array([], pa.int64())})


def _all_links(keys, table):
    """All links between two blocks of a group, or within one."""
    node, _, sets, (block,) = _rows(table, ["block"])
    got, one = _Compared(sets), keys[1].as_py() == keys[2].as_py()
    a, b = [], []
    for i in range(len(node) - 1):
        rest = np.arange(i + 1, len(node))
        found = got.linked(i, rest if one else rest[block[rest] != block[i]])
        a.append(np.full(len(found), node[i]))
        b.append(node[found])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _near(batches):
    """Keeps the candidate pairs that sizes and short sketches allow, with the sketches' distance."""
    for batch in batches:
        col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
        n_a, n_b = col("n_a").to_numpy(), col("n_b").to_numpy()
        least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        ok = least * 100 >= most * MIN_SIMILARITY
        far = np.zeros(len(ok), np.int64)
        x, y = col("sketch_a"), col("sketch_b")
        for i in np.flatnonzero(ok).tolist():
            p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            size = min(len(p), len(q))
            far[i] = int(np.bitwise_count(fold(p, size) ^ fold(q, size)).sum())
        ok &= far <= (n_a + n_b) * (100 - MIN_SIMILARITY) // (100 + MIN_SIMILARITY)
        yield batch.select(["a", "b"]).append_column("far", pa.array(far)).filter(pa.array(ok))


def _verify(batches):
    """Exact test of pairs of whole sets."""
    for batch in batches:
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("hashes_a", "hashes_b"))
        good = []
        for i in range(batch.num_rows):
            p, q = np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= MIN_SIMILARITY * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _shingled(batches):
    """The shingles of nodes' texts; an id may have further texts, which are not the node's."""
    for batch, raw, at in K.steps(batches):
        sets = shingle_hashes(raw, at)
        keys = batch.column(batch.schema.get_field_index("set_key")).to_pylist()
        own = [len(h) > 0 and set_key(h) == k for h, k in zip(sets, keys, strict=True)]
        node = batch.column(batch.schema.get_field_index("node")).filter(pa.array(own, pa.bool_()))
        yield pa.RecordBatch.from_arrays([node, pa.array([h.tobytes() for h, x in zip(sets, own, strict=True) if x], pa.binary())], ["node", "hashes"])


class _Candidates:
    """Steps 1 to 3 of the join, and the sets of the documents that take part in what follows."""

    def __init__(self, docs: DataFrame, space: Workspace):
        self.space = space
        spark = docs.sparkSession
        kind = "doc_id long, version long, n_shingles long, set_key binary, set_id long, sketch binary, task long, chunk int, counts binary"
        measured = space.save(docs.mapInArrow(_measure, kind), "measured")
        self.rows = measured.where("chunk is null").select("doc_id", "version", "n_shingles", "set_key", "set_id", "sketch")
        counts = measured.where("chunk is not null").select("task", "chunk", "counts")
        tasks = 1 + (counts.agg(F.max("task")).first()[0] or 0)
        while True:
            tasks = -(-tasks // FAN_IN)
            counts = counts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("chunk", "task").applyInArrow(_add, "task long, chunk int, counts binary")
            if tasks <= 1:
                break
        merged = {r["chunk"]: np.frombuffer(r["counts"], np.uint16) for r in counts.collect()}  # CHUNKS rows, whatever the input
        count = np.concatenate([merged.get(c, np.zeros(COUNTERS // CHUNKS, np.uint16)) for c in range(CHUNKS)])
        rank = spark.sparkContext.broadcast(np.round(8 * np.log2(count + 1.0)).astype(np.uint8))  # COUNTERS bytes

        ranges = spread(docs, 6 << 20)
        blocks = docs.select("text").mapInArrow(_emit(rank, ranges), "range int, block binary")
        found = space.save(blocks.groupBy("range").applyInArrow(_groups, "a long, b long, members binary"), "found")
        sets = self.rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("set_id").alias("set_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        self.sets = space.save(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # numbered once, as it is written

        of = lambda side: self.sets.select(F.col("set_id").alias(f"id_{side}"), F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = found.where("a is not null").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
        self.pairs = space.save(pairs.join(of("b"), "id_b").join(of("a"), "id_a").mapInArrow(_near, "a long, b long, far long"), "near")
        members = found.where("members is not null").select("members").distinct().mapInArrow(_spell_out, "grp long, set_id long, pivot boolean")
        members = members.groupBy("grp", "set_id").agg(F.max("pivot").alias("pivot"))
        self.members = space.save(members.join(self.sets.select("set_id", "node", "n"), "set_id").select("grp", "node", "n", "pivot"), "members")
        space.drop("found")
        size = self.members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        self.sizes = space.save(size, "sizes")

        part = self.members.select("node").union(self.pairs.select("a")).union(self.pairs.select("b")).distinct()
        wanted = part.join(self.sets.select("node", "doc", "set_key"), "node")
        texts = docs.where("text is not null").select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc")
        self.shingled = space.save(texts.select("node", "set_key", "text").mapInArrow(_shingled, "node long, hashes binary").dropDuplicates(["node"]), "shingled")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        of = lambda side: self.shingled.select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}"))
        return self.space.save(pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").mapInArrow(_verify, "a long, b long"), name)

    def blocked(self) -> DataFrame:
        """Members of large groups with their block, and the number of blocks of their group."""
        dealt = self.members.join(self.sizes, "grp")
        return dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Adds to rows of nodes their component; a node without links is its own."""
    return rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _joined(space: Workspace, label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after further links: components are found over the components so far, never again over their links."""
    if links.isEmpty():
        return label
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    more = components(space, between, f"{name}-joined")
    return space.save(relabelled(label, more).union(more.join(label, "node", "left_anti").select("node", "component")), f"{name}-labels")


def _components(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, Workspace]:
    """The measured rows, and ``(set_key, component)`` of every set."""
    spark = docs.sparkSession
    space = Workspace(spark, "sketch-join")
    own_text = F.col(text).cast("string")
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), own_text.alias("text"), F.xxhash64(own_text).alias("version"))
    got = _Candidates(docs, space)
    link = "a long, b long"
    label = spark.createDataFrame([], "node long, component long")
    if not got.sizes.isEmpty():
        blocked = got.blocked()
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        visits = blocked.withColumn("block", F.explode(F.when(F.col("pivot") & (F.col("blocks") > 1), every).otherwise(F.array("block"))))
        inside = visits.select("grp", "block", "node", F.lit(False).alias("driver")).join(got.shingled, "node").groupBy("grp", "block").applyInArrow(_forest, link)
        label = components(space, space.save(inside, "inside"), "inside")
        many = _labelled(blocked.where("blocks > 1").select("grp", "block", "blocks", "node"), label)
        many = space.save(many, "many")
        parts = many.groupBy("grp", "component").agg(F.count("*").alias("size"))
        main = parts.groupBy("grp").agg(F.max_by("component", F.struct("size", "component")).alias("main"), (F.sum("size") - F.max("size")).alias("outside")).where("outside > 0")
        main = space.save(main.select("grp", "main", F.ceil(F.col("outside") / GROUP_BLOCK).cast("int").alias("out_blocks")), "main")
        if not main.isEmpty():
            opened = many.join(main, "grp")
            out_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("out_blocks")).cast("int").alias("out_block")
            drivers = opened.where("component <> main").select("grp", out_block, F.explode(every).alias("block"), "node", "component", F.lit(True).alias("driver"))
            targets = opened.select("grp", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("out_block"), "block", "node", "component", F.lit(False).alias("driver"))
            far = drivers.union(targets).join(got.shingled, "node").groupBy("grp", "out_block", "block").applyInArrow(_across, link)
            label = _joined(space, label, space.save(far, "far"), "far")
    # Pairs of small groups, for each set its nearest partner first.
    nearest = got.pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("best.a", "b")
    for turn, pairs in enumerate((nearest, got.pairs.select("a", "b"))):
        of = lambda side, label=label: label.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        pairs = space.save(pairs, f"pairs-{turn}")
        if not pairs.isEmpty():
            label = _joined(space, label, got.verified(pairs, f"links-{turn}"), f"pairs-{turn}")
    return got.rows, _labelled(got.sets.select("node", "set_key", "doc"), label), space


def _named(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, Workspace]:
    """Measured rows with ``component`` (null without shingles) and ``component_id``."""
    rows, sets, space = _components(docs, text, doc_id)
    of_set = space.save(sets, "of-set")
    least = space.save(of_set.groupBy("component").agg(F.min("doc").alias("component_id")), "least")  # plain tables, so that hot components can be split
    named = space.save(of_set.join(least, "component").select("set_key", "component", "component_id"), "named")
    rows = rows.select("doc_id", "version", "n_shingles", "set_key")
    blank = rows.where("set_key is null").select("doc_id", "version", "n_shingles", "set_key", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.where("set_key is not null").join(named, "set_key").select(blank.columns).union(blank), space


def _shown(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def sketch_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id)``, one for each row of ``docs``."""
    return _named(docs, text, doc_id)[0].select(_shown("doc_id"), "n_shingles", _shown("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, less all but one row of every component; columns as they are.

    The row with the least id stays; of several rows with that id the one whose text has the least hash, and of rows
    with that id and text any one. Rows without shingles all stay.
    """
    rows, space = _named(docs, "text", "doc_id")
    linked = space.save(rows.where("component is not null").select("doc_id", "version", "component"), "linked")
    best = linked.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("best"))
    gone = linked.join(best, "component").where("best.doc_id <> doc_id or best.version <> version").select(F.col("doc_id").alias("__d"), F.col("version").alias("__v")).distinct()
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__version": F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(gone, (F.col("__doc") == F.col("__d")) & (F.col("__version") == F.col("__v")), "left_anti")
    again = space.save(linked.groupBy(F.col("doc_id").alias("__d"), F.col("version").alias("__v")).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "again")
    if not again.isEmpty():
        same = (F.col("__doc") == F.col("__d")) & (F.col("__version") == F.col("__v"))
        one = kept.join(again, same, "left_semi").groupBy("__doc", "__version").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
        return kept.join(again, same, "left_anti").select(*docs.columns).union(one)
    return kept.select(*docs.columns)


def _links(docs: DataFrame, text: str, doc_id: str) -> tuple[_Candidates, DataFrame]:
    """The candidates, and all links ``(a, b)`` of different sets by their nodes."""
    space = Workspace(docs.sparkSession, "sketch-links")
    own_text = F.col(text).cast("string")
    got = _Candidates(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), own_text.alias("text"), F.xxhash64(own_text).alias("version")), space)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = got.blocked().withColumn("other", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "driver": F.lit(False)})
    inside = both.select("grp", "x", "y", "block", "node", "driver").join(got.shingled, "node").groupBy("grp", "x", "y").applyInArrow(_all_links, "a long, b long")
    few = got.verified(got.pairs, "few").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return got, space.save(few.union(inside).distinct(), "links")


def sketch_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``(a, b)``: every link of two different sets, by the least document of each; ``a <= b``."""
    got, links = _links(docs, text, doc_id)
    of = lambda side: got.sets.select(F.col("node").alias(side), F.col("doc").alias(f"doc_{side}"))
    named = links.join(of("a"), "a").join(of("b"), "b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))
    return named.select(_shown("a"), _shown("b"))


def link_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``(doc_id, n_links)``, one for each row of ``docs``: how many other rows it links to, equal sets among them."""
    got, links = _links(docs, text, doc_id)
    size = got.rows.where("set_key is not null").groupBy("set_key").agg(F.count("*").alias("size")).join(got.sets.select("set_key", "node"), "set_key")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(size.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("far"))
    total = size.join(far, "node", "left").select("set_key", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return got.rows.join(total, "set_key", "left").select(_shown("doc_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
