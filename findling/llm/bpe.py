"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

``Codec`` reads a byte-level BPE file of the tokenizers library. Its encoder works on flat bytes:

* A rolling hash of the last 16 bytes ends a chunk where its low bits are zero, so equal passages of any
  documents give equal chunks wherever they stand. A chunk is encoded once, as if it were a text, and kept in a table of the
  Python worker (bounded by ``TABLE_SLOTS`` and ``TABLE_BYTES``); its ids are reused only for equal bytes.
* A chunk may begin and end inside a word, so ids near its ends may not be those of the whole text. A *join* of two
  chunks is repaired by encoding anew from the last but one sure boundary of the left chunk to the second of the
  right one. A sure boundary is a place at which the pre-tokenizer ends a piece whatever stands
  farther off: letters, digits and other characters meet there, or white space follows one. The repair must
  agree on both sides: its ids before the left chunk's last sure boundary and after the right chunk's first one must be those
  kept for the chunks. Where they are not, or a chunk has too few sure boundaries, the chunk gives up what it kept and
  the repair reaches on to the next one, until both sides agree or the text ends. Repairs are kept in the table too.

Ids are tested against the tokenizers library itself. Strings of special tokens in a text become their ids,
as that library does by default, unless ``ordinary`` asks for plain text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import _kernel as K
from ._shared import Workspace

#: The split pattern that the byte-level pre-tokenizer applies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Slots and bytes of a worker's table of encoded segments, and the longest segment that it keeps.
TABLE_SLOTS = 1 << 20
TABLE_BYTES = 96 << 20
KEEP_BYTES = 8192
#: Bytes under the rolling hash, and the mean length of a chunk.
ROLL_BYTES = 16
CHUNK_BYTES = 512

_U = np.uint64


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def spread_out(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes ``start[i] .. start[i] + length[i] - 1`` of all i, one after the other."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)


_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point that Unicode 3.2 and the current version agree on; 0 for all others."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x30000):
            c = chr(i)
            then, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
            if then[0] == now[0] and now[0] not in "C" and now != "Zl" and now != "Zp":
                table[i] = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}.get(now[0], _OTHER)
        table[[9, 10, 11, 12, 13]] = _SPACE
        _classes.append(table)
    return _classes[0]


class Codec:
    """Encoder and decoder of one vocabulary file; made once in each Python worker (see ``codec``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in added.items()}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in added}
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        single = len(ranks) - len(merges)
        in_order = all(vocab.get(a + b) == single + i for i, (a, b) in enumerate(merges))
        pre = spec.get("pre_tokenizer") or {}
        if not in_order or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file with ids in the order of merges is needed")
        self.core = tiktoken.Encoding("codec", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        size = max(max(vocab.values()), *added.values(), 0) + 1
        self.ids_end = size
        spelled = [b""] * size
        for token, i in ranks.items():
            spelled[i] = token
        for token, i in self.special.items():
            spelled[i] = token
        self.token_bytes = self._table(spelled)
        self.token_digits = self._table([b"%d," % i for i in range(size)])
        self.encoded = 0  # bytes that went through the byte-pair core
        self.clear()

    @staticmethod
    def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(x) for x in items])
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(length) - length, length

    def clear(self) -> None:
        self.key = np.zeros(TABLE_SLOTS, _U)
        self.slot = np.zeros(TABLE_SLOTS, np.int32)
        self.begin, self.size = np.zeros(TABLE_SLOTS, np.int64), np.zeros(TABLE_SLOTS, np.int32)
        self.byte_at, self.byte_size = np.zeros(TABLE_SLOTS, np.int64), np.zeros(TABLE_SLOTS, np.int32)
        self.ids, self.bytes = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.uint8)
        self.known = self.used = self.bytes_used = 0

    # The table: open addressing on the segment's hash, all probes vectorised.

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        open_, at = np.arange(len(h)), (h & _U(TABLE_SLOTS - 1)).astype(np.int64)
        while len(open_):
            key = self.key[at]
            hit = key == h[open_]
            out[open_[hit]] = self.slot[at[hit]]
            on = ~hit & (key != 0)
            open_, at = open_[on], (at[on] + 1) & (TABLE_SLOTS - 1)
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        open_, at = np.arange(len(h)), (h & _U(TABLE_SLOTS - 1)).astype(np.int64)
        while len(open_):
            free = self.key[at] == 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.key[at[take]], self.slot[at[take]] = h[open_[take]], number[open_[take]]
            open_, at = open_[~take], (at[~take] + ~free[~take].astype(bool)) & (TABLE_SLOTS - 1)

    def _core_encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments one after the other, and the number of ids of each.

        Segments that begin with a space and end with another character can't touch one another, so they
        are encoded in one text; the few others (at the ends of documents) by themselves.
        """
        lead, tail = raw[start], raw[end - 1]
        joint = ((lead == 32) | (lead == 10)) & (tail > 32) & (tail < 127)
        count = np.zeros(len(start), np.int64)
        one = np.flatnonzero(~joint)
        alone = []
        for i in one.tolist():
            alone.append(np.array(self.core.encode_ordinary(raw[start[i] : end[i]].tobytes().decode()), np.uint32))
            count[i] = len(alone[-1])
        many = np.flatnonzero(joint)
        joined = np.zeros(0, np.uint32)
        if len(many):
            length = end[many] - start[many]
            joined = np.array(self.core.encode_ordinary(raw[spread_out(start[many], length)].tobytes().decode()), np.uint32)
            close = np.cumsum(self.token_bytes[2][joined])
            stop = np.searchsorted(close, np.cumsum(length)) + 1
            count[many] = np.diff(stop, prepend=0)
        out = np.empty(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        out[spread_out(first[many], count[many])] = joined
        for i, x in zip(one.tolist(), alone, strict=True):
            out[first[i] : first[i] + len(x)] = x
        return out, count

    @staticmethod
    def _equal(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of x and y at the given places are equal, ``size`` of each and at least one."""
        if not len(size):
            return np.zeros(0, bool)
        same = x[spread_out(at, size)] == y[spread_out(there, size)]
        return np.logical_and.reduceat(same, np.cumsum(size) - size)

    def _append(self, name: str, used: int, more: np.ndarray) -> None:
        held = getattr(self, name)
        while used + len(more) > len(held):
            held = np.concatenate((held, np.zeros(len(held), held.dtype)))
        held[used : used + len(more)] = more
        setattr(self, name, held)

    def _segments(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments through the table, and the number of ids of each. Equal hashes count only with equal bytes."""
        length = end - start
        h = K.span_hash(raw, start, end) | _U(1)
        kinds, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        odd = length != length[first][inverse]
        odd[~odd] = ~self._equal(raw, start[~odd], raw, start[first][inverse[~odd]], length[~odd])
        if odd.any():  # two segments share a hash: those unlike the first are kinds of their own, which the table doesn't get
            which = np.flatnonzero(odd)
            inverse[which] = len(kinds) + np.arange(len(which))
            first = np.concatenate((first, which))
        number = np.concatenate((self._find(kinds), np.full(len(first) - len(kinds), -1, np.int64)))
        old = np.flatnonzero(number >= 0)
        same = self.byte_size[number[old]] == length[first[old]]
        same[same] = self._equal(raw, start[first[old[same]]], self.bytes, self.byte_at[number[old[same]]], length[first[old[same]]])
        number[old[~same]] = -2  # the slot is another segment's
        new = np.flatnonzero(number < 0)
        s, e = start[first[new]], end[first[new]]
        self.encoded += int((e - s).sum())
        ids, count = self._core_encode(raw, s, e)
        begin = np.cumsum(count) - count
        at, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        old = np.flatnonzero(number >= 0)
        at[old], size[old] = self.begin[number[old]], self.size[number[old]]
        pool = np.concatenate((self.ids[: self.used], ids)) if len(old) else ids
        at[new], size[new] = begin + (self.used if len(old) else 0), count
        out = pool[spread_out(at[inverse], size[inverse])]
        kept = np.flatnonzero((e - s <= KEEP_BYTES) & (number[new] == -1) & (new < len(kinds)))
        total_bytes = int((e - s)[kept].sum())
        if self.known + len(kept) > TABLE_SLOTS // 2 or self.bytes_used + total_bytes > TABLE_BYTES:
            self.clear()
        if len(kept) and len(kept) <= TABLE_SLOTS // 2:
            fresh = np.arange(self.known, self.known + len(kept))
            self.begin[fresh] = self.used + np.cumsum(count[kept]) - count[kept]
            self.size[fresh] = count[kept]
            self._append("ids", self.used, ids[spread_out(begin[kept], count[kept])])
            self.used += int(count[kept].sum())
            own = (e - s)[kept]
            self.byte_at[fresh], self.byte_size[fresh] = self.bytes_used + np.cumsum(own) - own, own
            self._append("bytes", self.bytes_used, raw[spread_out(s[kept], own)])
            self.bytes_used += total_bytes
            self._place(kinds[new[kept]], fresh.astype(np.int32))
            self.known += len(kept)
        return out, size[inverse]

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        """Safe cuts: a space or line feed whose left neighbour surely isn't white space."""
        n = len(raw)
        left = np.zeros(n, bool)
        prev = raw[:-1]
        good = (prev > 32) & (prev != 127)
        two = np.zeros(n - 1, np.uint8)
        two[1:] = raw[:-2]
        three = np.zeros(n - 1, np.uint8)
        three[2:] = raw[:-3]
        wide = (two == 0xC2) & ((prev == 0x85) | (prev == 0xA0)) | ((three >= 0xE1) & (three <= 0xE3)) & ((two == 0x9A) | (two == 0x80) | (two == 0x81))
        left[1:] = good & ~((prev >= 128) & wide)
        return np.flatnonzero(left & ((raw == 32) | (raw == 10)))

    def _parts(self, raw: np.ndarray, at: np.ndarray, ordinary: bool) -> tuple[np.ndarray, dict[int, int]]:
        """Where texts and special tokens begin and end, and the id for each part that is a special token."""
        if ordinary or not self.special or not len(raw):
            return at, {}
        data, found = raw.tobytes(), {}
        for token, number in self.special.items():
            i = data.find(token)
            while i >= 0:
                doc = int(np.searchsorted(at, i, "right")) - 1
                if i + len(token) <= at[doc + 1]:
                    found[i] = (i + len(token), number)
                i = data.find(token, i + len(token))
        if not found:
            return at, {}
        edge = np.concatenate((at, [*found], [x[0] for x in found.values()]))
        return np.sort(edge), {i: x[1] for i, x in found.items()}

    def encode(self, raw: np.ndarray, at: np.ndarray, chunked: bool = False, ordinary: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text in them.

        ``chunked`` reuses content-defined chunks and repairs their joins; else the pieces between
        safe cuts are reused one by one.
        """
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        edge, special = self._parts(raw, at, ordinary)
        bound = np.unique(edge)
        if chunked:
            start, end = bound[:-1], bound[1:]
        else:
            cut = self._cuts(raw) if len(raw) > 3 else np.zeros(0, np.int64)
            start = np.union1d(bound[:-1], cut)
            end = np.append(start[1:], len(raw))
        encode = self._chunks if chunked else self._segments
        if special:
            mark = np.isin(start, np.fromiter(special, np.int64))
            count = np.ones(len(start), np.int64)
            ids, count[~mark] = encode(raw, start[~mark], end[~mark])
            out = np.empty(int(count.sum()), np.uint32)
            first = np.cumsum(count) - count
            out[first[mark]] = [special[i] for i in start[mark].tolist()]
            out[spread_out(first[~mark], count[~mark])] = ids
            ids = out
        else:
            ids, count = encode(raw, start, end)
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(start, at)]

    @staticmethod
    def _sure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places of the sure boundaries, and of the character four before each (what decides it lies between)."""
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = character_classes()[code]
        left, right = kind[:-1], kind[1:]
        sure = (left > 0) & (right > 0) & (left != _SPACE) & (left != right)
        quote = np.concatenate((np.zeros(3, bool), code == 0x27))  # contractions are pieces of their own
        for back in range(4):
            sure &= ~quote[4 - back : 4 - back + len(sure)]
        at = np.flatnonzero(sure) + 1
        return place[at], place[np.maximum(at - 4, 0)]

    def _chunks(self, raw: np.ndarray, part_start: np.ndarray, part_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of the text by chunks and repaired joins, and the number of ids of each part."""
        if not len(part_start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        here = np.arange(min(ROLL_BYTES, len(raw)), len(raw))
        roll = K.gram_hash(K.prefix_hash(raw), here - ROLL_BYTES, here)
        ends = here[((roll & _U(CHUNK_BYTES - 1)) == 0) & ((raw[here] & 0xC0) != 0x80)]
        of = np.searchsorted(part_start, ends, "right") - 1
        ends = ends[(of >= 0) & (ends < part_end[np.maximum(of, 0)])]
        start = np.union1d(part_start, ends)
        part = np.searchsorted(part_start, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), part_end[part])
        ids, count = self._segments(raw, start, end)
        n = len(start)
        opens, closes = np.append(True, part[1:] != part[:-1]), np.append(part[1:] != part[:-1], True)
        # Sure boundaries of each chunk: the first two and the last two.
        cut, context = self._sure(raw)
        chunk = np.searchsorted(start, cut, "right") - 1
        good = (chunk >= 0) & (context >= start[np.maximum(chunk, 0)]) & (cut < end[np.maximum(chunk, 0)])
        cut, chunk = cut[good], chunk[good]
        lo, hi = np.searchsorted(chunk, np.arange(n)), np.searchsorted(chunk, np.arange(n), "right")
        held = np.append(cut, [0, 0])
        one, two, last, before = held[lo], held[np.minimum(lo + 1, len(cut))], held[hi - 1], held[hi - 2]
        # What a chunk keeps: all between its repairs. The token that begins at byte b of the chunks' text is close.searchsorted(b') + 1.
        keep_from, keep_to = np.where(opens, start, two), np.where(closes, end, before)
        kept = (opens & closes) | (hi - lo >= np.where(opens | closes, 2, 3))
        size = end - start
        flat_start = np.cumsum(size) - size  # places in the chunks one after the other, special tokens left out
        close = np.cumsum(self.token_bytes[2][ids])
        token_at = lambda b, c: np.searchsorted(close, b - start[c] + flat_start[c], "right")
        while True:
            # Repairs go from one chunk that keeps ids (or the part's begin) to the next (or the part's end).
            k = np.flatnonzero(kept)
            p = np.arange(len(part_start))
            first_kept, last_kept = np.searchsorted(part[k], p), np.searchsorted(part[k], p, "right")
            empty = first_kept == last_kept
            head = np.append(k, 0)[first_kept]
            tail = np.append(k, 0)[last_kept - 1]
            lead, trail = ~empty & ~opens[head], ~empty & ~closes[tail]
            joined = np.flatnonzero(part[k][1:] == part[k][:-1]) if len(k) else np.zeros(0, np.int64)
            a, b = k[joined], k[joined + 1]
            none = np.full(len(part_start), -1)
            w_from = np.concatenate((part_start[empty], part_start[lead], keep_to[tail[trail]], keep_to[a]))
            w_to = np.concatenate((part_end[empty], keep_from[head[lead]], part_end[trail], keep_from[b]))
            w_left = np.concatenate((none[empty], none[lead], tail[trail], a))
            w_right = np.concatenate((none[empty], head[lead], none[trail], b))
            order = np.argsort(w_from, kind="stable")
            w_from, w_to, w_left, w_right = w_from[order], w_to[order], w_left[order], w_right[order]
            fixed, fixed_count = self._segments(raw, w_from, w_to) if len(w_from) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            fixed_start = np.cumsum(fixed_count) - fixed_count
            fixed_close = np.cumsum(self.token_bytes[2][fixed])
            w_size = w_to - w_from
            w_flat = np.cumsum(w_size) - w_size
            agree = np.ones(len(w_from), bool)
            for i, (side, c) in enumerate((("left", w_left), ("right", w_right))):
                rows = np.flatnonzero(c >= 0)
                own = c[rows]
                # The overlap: from the repair's begin to the left chunk's last sure boundary, or from the right chunk's first to the repair's end.
                x, y = (w_from[rows], last[own]) if side == "left" else (one[own], w_to[rows])
                t0, t1 = token_at(x, own), token_at(y, own)
                f0, f1 = (np.searchsorted(fixed_close, z - w_from[rows] + w_flat[rows], "right") for z in (x, y))
                ok = (t1 - t0 == f1 - f0) & (t1 > t0)
                same = np.zeros(len(rows), bool)
                same[ok] = self._equal(ids, t0[ok], fixed, f0[ok], (t1 - t0)[ok])
                agree[rows] &= same
            if agree.all():
                break
            bad = np.concatenate((w_left[~agree], w_right[~agree]))
            kept[bad[bad >= 0]] = False
        # Kept stretches and repairs in the order of the text.
        t0, t1 = token_at(keep_from[k], k), token_at(keep_to[k], k)
        begin = np.concatenate((t0, len(ids) + fixed_start))
        many = np.concatenate((t1 - t0, fixed_count))
        where = np.concatenate((keep_from[k], w_from))
        order = np.lexsort((np.concatenate((np.ones(len(k), np.int64), np.zeros(len(w_from), np.int64))), where))
        out = np.concatenate((ids, fixed))[spread_out(begin[order], many[order])]
        return out, np.bincount(np.searchsorted(part_start, where, "right") - 1, many, len(part_start)).astype(np.int64)

    def spell(self, ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids by a table of tokens or digits, and where each id ends."""
        flat, begin, length = table
        size = length[ids]
        return flat[spread_out(begin[ids], size)], np.concatenate(([0], np.cumsum(size)))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spell(ids, self.token_bytes)[0].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def library(path: str) -> Tokenizer:
    """The tokenizers library's own encoder of the file, which the tests compare with."""
    return Tokenizer.from_file(path)


def _report(path: str):
    def run(batches):
        bpe = codec(path)
        for batch, raw, at in K.steps(batches):
            ids, of = bpe.encode(raw, at, chunked=True)
            text, text_at = bpe.spell(ids, bpe.token_bytes)
            digits, digit_at = bpe.spell(ids, bpe.token_digits)
            text, digits = memoryview(np.ascontiguousarray(text)), memoryview(np.ascontiguousarray(digits))
            bounds = list(zip(of[:-1].tolist(), of[1:].tolist(), strict=True))
            columns = [
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array(np.diff(of)),
                pa.array([hashlib.sha256(digits[digit_at[a] : max(digit_at[a], digit_at[b] - 1)]).hexdigest() for a, b in bounds]),
                pa.array([hashlib.sha256(bytes(text[text_at[a] : text_at[b]]).decode(errors="replace").encode()).hexdigest() for a, b in bounds]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_report(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one for each row of ``docs``; null text is empty."""
    Workspace(docs.sparkSession, "bpe")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_report(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str, text: str, out: str):
    def run(batches):
        bpe = codec(path)
        for batch, raw, at in K.steps(batches, text):
            ids, of = bpe.encode(raw, at, chunked=True)
            yield batch.append_column(out, pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(ids.astype(np.int32))))

    return run


def encode_column(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the ids of ``text`` as an array column; null text gives an empty array."""
    Workspace(docs.sparkSession, "bpe")
    kind = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(path, text, out), kind)


def _decode(path: str, ids: str, out: str):
    def run(batches):
        bpe = codec(path)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode(errors="replace") for x in rows.to_pylist()]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return run


def decode_column(docs: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; null stays null."""
    Workspace(docs.sparkSession, "bpe")
    return docs.mapInArrow(_decode(path, ids, out), T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))
