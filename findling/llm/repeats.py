"""Exact removal of long repeated byte strings through a suffix-ordered collection.

Every byte that a ``width``-byte string covers which also starts anywhere else (in the same text too) is
removed; strings are judged on the input. The decision is made by a collection Burrows-Wheeler transform
with common prefixes, built column-wise: each round inserts one symbol of every member in front of the
suffixes so far, by LF mapping, reading the transform and the prefixes of the last round from sequential
files and writing those of the next. Building it over all bytes of a corpus is out of reach, so exact
sieves pick the members first:

1. In each window of ``width`` bytes the 32-byte gram with the least hash (the leftmost of equals) is its
   anchor. Equal windows have equal anchors at equal places, so only windows of the same anchor gram can be
   equal. Consecutive windows with one anchor form a *stretch*.
2. An anchor gram that occurs once has no repeats. Stretches that are equal as a whole are repeated as a
   whole. What is left are different stretches around one gram.
3. Those are cut, at places fixed relative to the anchor, into blocks of 64 windows. All windows of a block
   contain its core of 337 bytes, so only blocks with the same core and place can share a window.
4. Blocks with equal cores form the members of collections. As the core is the same string in all members
   of its group, it takes part as one symbol (a wider alphabet) that counts 337 in common prefixes; members
   have at most 127 symbols and the construction at most 128 rounds. Two neighbours in suffix order with a
   common prefix of ``width`` or more prove both windows repeated.
5. A core that more than ``GROUP`` different blocks share is cut into blocks of 8 windows, and at last of 1,
   where equal cores are equal windows. So no group is ever dropped or held whole in one task.

Null texts are empty, nothing in a text shorter than ``width`` is repeated, and rows with the same id and
text are separate texts (each repeats the other). A text beyond ``SEGMENT_BYTES`` is read in segments that overlap by a
window. Where a removed string begins or ends inside a character, the text that is left loses the rest of that
character too; digests are those of the bytes themselves. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import MOST_TASKS, ROW_KEY, Workspace, row_key

WIDTH = 400
#: What a corpus is cleaned by: 50 words of running text are longer in 99 of 100 places (measured on four languages).
PASSAGE_BYTES = 200
SEGMENT_BYTES = 8 << 20
GRAM = 32
#: Windows of a block by level, and the different blocks of one core that a collection takes.
LEVELS = (64, 8, 1)
GROUP = 4096
#: Members of the collections that one task builds at a time, on average.
MEMBERS = 2000
#: Bytes of a round's files that stay in memory before they go to disk.
ROUND_BYTES = 64 << 20

_U = np.uint64
_PLACE = _U((1 << 28) - 1)  # within a segment


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _stretches(width: int):
    """Rows (rk, place, h, c): windows with one anchor; place packs start, number of windows and lead."""
    span = width - GRAM + 1

    def segments(batches):
        for batch, raw, at in K.steps(batches):
            for off in range(0, max(1, len(raw) - width + 1), SEGMENT_BYTES):  # one, unless a single text is that long
                part = raw[off : off + SEGMENT_BYTES + width - 1] if len(at) == 2 else raw
                yield batch, part, np.array([0, len(part)]) if len(at) == 2 else at, off
                if len(at) > 2:
                    break

    def run(batches):
        for batch, raw, at, off in segments(batches):
            n = len(raw)
            if n < width:
                continue
            prefix = K.prefix_hash(raw)
            gram = np.arange(n - GRAM + 1)
            h = K.gram_hash(prefix, gram, gram + GRAM)
            key = (h & ~_PLACE) | gram.astype(_U)
            size = -(-len(key) // span) * span
            tiled = np.full(size, ~_U(0))
            tiled[: len(key)] = key
            tiled = tiled.reshape(-1, span)
            left = np.minimum.accumulate(tiled, 1).ravel()
            right = np.minimum.accumulate(tiled[:, ::-1], 1)[:, ::-1].ravel()
            starts = n - width + 1
            anchor = (np.minimum(right[:starts], left[span - 1 : span - 1 + starts]) & _PLACE).astype(np.int64)
            edge = np.zeros(starts, bool)
            edge[0] = True
            edge[1:] = anchor[1:] != anchor[:-1]
            for x in (at[:-1], np.maximum(at[1:] - width + 1, at[:-1])):
                edge[x[x < starts]] = True
            lo = np.flatnonzero(edge)
            hi = np.append(lo[1:], starts)
            doc = np.searchsorted(at, lo, "right") - 1
            ok = lo + width <= at[doc + 1]
            lo, hi, doc = lo[ok], hi[ok], doc[ok]
            if not len(lo):
                continue
            view = memoryview(np.ascontiguousarray(raw))
            body = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + width - 1]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), _U, len(lo))
            spot = anchor[lo]
            place = ((lo - at[doc] + off) << 20) | ((hi - lo) << 10) | (spot - lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("rk")).take(pa.array(doc)), pa.array(place), pa.array(_signed(h[spot])), pa.array(_signed(body))],
                ["rk", "place", "h", "c"],
            )

    return run


def _blocks(width: int, windows: int):
    """Cuts bodies into blocks of ``windows`` aligned windows: rows (key, body, h, c, m, base, lead, n)."""

    def run(batches):
        for batch in batches:
            h, c, m, base, lead, n, text = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("h", "c", "m", "base", "lead", "n", "text"))
            out = []
            for i in range(batch.num_rows):
                view, s = memoryview(text[i]), 0
                while s < n[i]:
                    p = (lead[i] - s) // windows
                    e = min(n[i], lead[i] - p * windows + 1)  # the last window of the block starts p * windows before the anchor
                    core = lead[i] - p * windows
                    key = xxhash.xxh3_64_intdigest(view[core : core + width - windows + 1], seed=((h[i] & 0xFFFFFFFFFFFFF) << 9) ^ p)
                    own = xxhash.xxh3_64_intdigest(view[s : e + width - 1], seed=e - s)
                    out.append((key - (1 << 63), own - (1 << 63), h[i], c[i], m[i], base[i] + s, lead[i] - s, e - s))
                    s = e
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8, ["key", "body", "h", "c", "m", "base", "lead", "n"])

    return run


class _Round:
    """The transform, the common prefixes and the suffix names of one round, as one sequential file."""

    def __init__(self, *columns: np.ndarray):
        self.file = tempfile.SpooledTemporaryFile(max_size=ROUND_BYTES)
        self.kinds = [(x.dtype, x.nbytes) for x in columns]
        for x in columns:
            self.file.write(x.tobytes())

    def read(self) -> list[np.ndarray]:
        self.file.seek(0)
        columns = [np.frombuffer(self.file.read(size), kind) for kind, size in self.kinds]
        self.file.close()
        return columns


def collection_repeats(members: list[np.ndarray], weight: np.ndarray, width: int) -> list[np.ndarray]:
    """For each member the places whose suffix shares a prefix of ``width`` or more with another suffix.

    Members are symbols of 1 and above; a symbol ``x`` counts ``weight[x]`` in common prefixes.
    """
    m = len(members)
    size = np.array([len(x) for x in members])
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate([*members, np.zeros(1, np.uint16)])
    before = lambda who, t: np.where(t < size[who], flat[np.maximum(begin[who + 1] - 1 - t, 0)], 0).astype(np.uint16)
    who = np.arange(m)
    held = _Round(before(who, 0), np.zeros(m, np.int32), who.astype(np.int64))
    at = who.copy()  # where the newest suffix of each member stands
    for t in range(1, int(size.max(initial=0)) + 1):
        bwt, common, name = held.read()
        more = size[who] >= t
        who, at = who[more], at[more]
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        done = n - int(np.count_nonzero(bwt))  # the members that are whole have nothing in front
        r, symbol = rank[at], bwt[at]  # in the order of at, so that ranges below are read in one sweep
        step = weight[symbol]
        padded = np.append(common, np.int32(0))

        def shared(lo: np.ndarray, hi: np.ndarray, padded=padded) -> np.ndarray:
            """The least common prefix over rows lo to hi, both included."""
            return np.minimum.reduceat(padded, np.stack((lo, hi + 1), 1).ravel())[::2]

        prior = order[np.maximum(r - 1, 0)]
        same = (r > 0) & (bwt[prior] == symbol)
        with_prior = np.where(same, step + shared(np.where(same, prior + 1, at), at), 0)
        after = order[np.minimum(r + 1, n - 1)]
        same = (r + 1 < n) & (bwt[after] == symbol)
        with_after = np.where(same, step + shared(np.where(same, at + 1, at), np.where(same, after, at)), 0)
        # Rows of earlier rounds keep their order; the new ones go between them.
        place = m + r - done
        own = np.argsort(place)
        who, place, with_prior, with_after = who[own], place[own], with_prior[own], with_after[own]
        total = n + len(who)
        old = np.ones(total, bool)
        old[place] = False
        next_bwt, next_common, next_name = np.empty(total, np.uint16), np.empty(total, np.int32), np.empty(total, np.int64)
        next_bwt[old], next_common[old], next_name[old] = bwt, common, name
        next_bwt[place], next_name[place] = before(who, t), t * m + who
        follow = place + 1
        next_common[follow[follow < total]] = with_after[follow < total]
        next_common[place] = with_prior
        at = place
        held = _Round(next_bwt, next_common, next_name)
    bwt, common, name = held.read()
    hit = common >= width
    hit[:-1] |= hit[1:].copy()
    name = name[hit]
    out: list[list[int]] = [[] for _ in range(m)]
    for j, t in zip((name % m).tolist(), (name // m).tolist(), strict=True):
        out[j].append(size[j] - t)
    return [np.sort(np.array(x, np.int64)) for x in out]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the runs of consecutive numbers."""
    if not len(places):
        return []
    lo = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1] + 1)))
    return list(zip(places[lo].tolist(), np.diff(np.append(lo, len(places))).tolist(), strict=True))


def _collect(width: int, windows: int):
    core = width - windows + 1

    def run(keys, table):
        key, body, lead, n, text = (table.column(x).to_pylist() for x in ("key", "body", "lead", "n", "text"))
        out = []
        ids = {k: i for i, k in enumerate(dict.fromkeys(key))}
        for first in range(0, len(ids), 60_000):  # symbols have 16 bits
            rows = [i for i in range(len(key)) if first <= ids[key[i]] < first + 60_000]
            members = []
            for i in rows:
                raw = np.frombuffer(text[i], np.uint8).astype(np.uint16) + np.uint16(1)
                at = lead[i] % windows  # where the core starts in this block
                members.append(np.concatenate((raw[:at], np.array([257 + ids[key[i]] - first], np.uint16), raw[at + core :])))
            weight = np.ones(257 + min(60_000, len(ids) - first), np.int32)
            weight[257:] = core
            for i, places in zip(rows, collection_repeats(members, weight, width), strict=True):
                out += [(key[i], body[i], a, k) for a, k in _runs(places[places < n[i]])]
        return pa.table({x: pa.array([r[j] for r in out], pa.int64()) for j, x in enumerate(("key", "body", "lo", "k"))})

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of half-open spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_spans(docs: DataFrame, space: Workspace, width: int = WIDTH) -> DataFrame:
    """Rows ``(rk, spans)``: the byte spans to remove of each row key with any. ``docs`` has (rk, text)."""
    stretch = space.save(docs.where(F.octet_length("text") >= width).select("rk", "text").mapInArrow(_stretches(width), f"rk {ROW_KEY}, place long, h long, c long"), "stretches")
    grams = stretch.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("h", F.expr("lo <> hi").alias("mixed"))
    grams = space.save(grams, "grams")  # a plain table on both sides of the join lets Spark split hot grams
    twice = space.save(stretch.join(grams, "h"), "twice")
    space.drop("stretches")
    contents = twice.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("rk", "place")).alias("rep"), F.first("mixed").alias("mixed"))
    contents = space.save(contents.select("h", "c", "m", "mixed", "rep.rk", "rep.place"), "contents")
    whole = contents.where("m > 1").select("h", "c", F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("k"))
    marks = [whole]
    place = F.col("place")
    picked = contents.where("mixed").select(
        "h", "c", "m", "rk", F.shiftright(place, 20).alias("start"), F.shiftright(place, 10).bitwiseAND(1023).alias("n"), place.bitwiseAND(1023).alias("lead")
    )
    cut = F.expr(f"substring(cast(text as binary), cast(start + 1 as int), cast(n + {width - 1} as int))")
    bodies = space.save(docs.select("rk", "text").join(picked, "rk").select("h", "c", "m", F.lit(0).cast("long").alias("base"), "lead", "n", cut.alias("text")), "bodies")
    for level, windows in enumerate(LEVELS):
        blocks = space.save(
            bodies.mapInArrow(_blocks(width, windows), "key long, body long, h long, c long, m long, base long, lead long, n long"), f"blocks-{level}"
        )
        kinds = blocks.groupBy("key", "body").agg(F.sum("m").alias("m"), F.min(F.struct("h", "c", "base", "lead", "n")).alias("rep"))
        cores = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("m").alias("all")).where("all > 1").select("key", "kinds")
        kinds = space.save(kinds.join(cores, "key").select("key", "body", "m", "kinds", "rep.*"), f"kinds-{level}")
        sure = blocks.join(kinds.where("m > 1").select("key", "body"), ["key", "body"]).select("h", "c", F.col("base").alias("lo"), F.col("n").alias("k"))
        marks.append(space.save(sure, f"sure-{level}"))
        open_kinds = kinds.where("kinds > 1")
        slice_of = F.expr(f"substring(text, cast(base - body_base + 1 as int), cast(n + {width - 1} as int))")
        held = bodies.select("h", "c", F.col("base").alias("body_base"), F.col("n").alias("body_n"), "text")
        inside = F.expr("base >= body_base and base < body_base + body_n")
        members = open_kinds.where(f"kinds <= {GROUP}").join(held, ["h", "c"]).where(inside).select("key", "body", "lead", "n", slice_of.alias("text"))
        members = space.save(members, f"members-{level}")
        many = max(1, members.count() // MEMBERS)
        parted = members.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(many))).repartition(min(many, MOST_TASKS), "part")
        found = parted.groupBy("part").applyInArrow(_collect(width, windows), "key long, body long, lo long, k long")
        found = space.save(found, f"found-{level}")
        marks.append(space.save(blocks.join(found, ["key", "body"]).where("m = 1").select("h", "c", (F.col("base") + F.col("lo")).alias("lo"), "k"), f"marks-{level}"))
        rest = open_kinds.where(f"kinds > {GROUP}").select("key", "body")
        if level + 1 == len(LEVELS) or rest.isEmpty():
            break
        again = blocks.join(rest, ["key", "body"])
        bodies = space.save(
            again.select("h", "c", "m", "base", "lead", "n").join(held, ["h", "c"]).where(inside).select("h", "c", "m", "base", "lead", "n", slice_of.alias("text")), f"bodies-{level + 1}"
        )
    mark = marks[0]
    for x in marks[1:]:
        mark = mark.union(x)
    start = F.shiftright("place", 20)
    full = F.shiftright("place", 10).bitwiseAND(1023)
    spans = twice.select("rk", "place", "h", "c").join(mark, ["h", "c"]).select(
        "rk",
        F.struct((start + F.col("lo")).alias("lo"), (start + F.col("lo") + F.when(F.col("k") < 0, full).otherwise(F.col("k")) + (width - 1)).alias("hi")).alias("span"),
    )
    return space.save(spans.groupBy("rk").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")


def _parts(raw: memoryview, spans: list[tuple[int, int]]) -> list[memoryview]:
    """What stands between the spans."""
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _rest(batches):
    """Applies the spans: counts and digest of what is left, and its text."""
    for batch in batches:
        col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
        text, spans = col("text").cast(pa.large_binary()), col("spans")
        n, gone, runs, digest, left = [], [], [], [], []
        for i in range(batch.num_rows):
            raw = text[i].as_buffer()
            raw = memoryview(raw) if raw is not None else memoryview(b"")
            cut = merge([(x["lo"], x["hi"]) for x in spans[i].as_py() or ()])
            parts = _parts(raw, cut)
            sha = hashlib.sha256()
            for part in parts:
                sha.update(part)
            n.append(len(raw))
            gone.append(sum(hi - lo for lo, hi in cut))
            runs.append(len(cut))
            digest.append(sha.hexdigest())
            left.append("".join(bytes(x).decode(errors="ignore") for x in parts))
        columns = [col("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def repeat_report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text)``, one for each row of ``docs``; ``text`` is what is left."""
    space = Workspace(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", row_key())
    spans = repeated_spans(docs, space, width)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return docs.join(spans, "rk", "left").select("doc_id", "text", "spans").mapInArrow(_rest, kind)


def _keep_text(batches):
    for batch in batches:
        index = batch.schema.get_field_index("text")
        text, spans = batch.column(index).cast(pa.large_binary()), batch.column(batch.schema.get_field_index("__spans"))
        out = []
        for i in range(batch.num_rows):
            raw = text[i].as_buffer()
            if raw is None:
                out.append(None)
                continue
            cut = merge([(x["lo"], x["hi"]) for x in spans[i].as_py() or ()])
            out.append("".join(bytes(x).decode(errors="ignore") for x in _parts(memoryview(raw), cut)))
        kind = batch.schema.field(index).type
        batch = batch.set_column(index, batch.schema.field(index), pa.array(out, kind))
        yield batch.drop_columns(["__spans"])


def without_repeats(docs: DataFrame, width: int = PASSAGE_BYTES) -> DataFrame:
    """The documents with repeated strings cut from ``text`` and ``n_chars`` adjusted; columns as they are."""
    space = Workspace(docs.sparkSession, "repeats")
    keyed = docs.withColumn("__rk", row_key())
    spans = repeated_spans(keyed.select(F.col("__rk").alias("rk"), "text"), space, width)
    joined = keyed.join(spans.select(F.col("rk").alias("__rk"), F.col("spans").alias("__spans")), "__rk", "left").drop("__rk")
    cut = joined.mapInArrow(_keep_text, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)
