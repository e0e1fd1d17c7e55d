"""Vectorised byte-level building blocks that the Arrow operators share.

Everything here works on a flat ``uint8`` buffer holding the UTF-8 bytes of several texts one after the
other, with ``offsets[i]:offsets[i + 1]`` the bytes of text ``i``. Nulls arrive as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one step works on; a single longer text is a step of its own. The arrays of a step take some fifty
#: times as much, in each of an executor's workers, and what a worker once took from the system it mostly keeps.
STEP_BYTES = 1 << 18

_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: The word separators of the contracts: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * STEP_BYTES), base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, which spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and a task of another kind may need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``STEP_BYTES`` each, with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = flatten(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP_BYTES, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
    give_back()


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Polynomial values (modulo 2**64) of all prefixes; see ``gram_hash``."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * _power("up", BASE, len(raw)), out=out[1:])
    return out


def gram_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A rolling hash of the bytes ``start:end``, whichever place they have.

    Only for choosing places (anchors, cuts): different strings of some shapes share a value for certain, so no
    equality may rest on it. ``span_hash`` is for that.
    """
    down = _power("down", BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Spans up to this length are hashed eight bytes at a time, all spans together; longer ones by xxh3.
LANED = 128
_BELOW = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``start:end``: every eight bytes pass through ``mix`` with what came before."""
    size = end - start
    out = mix(size.astype(np.uint64) * BASE + np.uint64(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > LANED)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    held = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(held[:8].view("<u8"), (len(raw) + 1,), (1,))
    open_ = np.flatnonzero((size > 0) & (size <= LANED))
    at, left = start[open_], size[open_]
    while len(open_):
        lane = eights[at]
        short = left < 8
        lane[short] &= _BELOW[left[short]]
        out[open_] = mix((out[open_] ^ lane) * np.uint64(0x9FB21C651E98DF25) + BASE)
        on = left > 8
        open_, at, left = open_[on], at[on] + 8, left[on] - 8
    return out


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of every text, and ``first[i]:first[i + 1]``, the words of text ``i``."""
    solid = np.zeros(len(raw) + 2, bool)
    np.logical_not(IS_SPACE[raw], out=solid[1:-1])
    begin = solid[1:] & ~solid[:-1]
    stop = solid[:-1] & ~solid[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    cut = inner[solid[inner] & solid[inner + 1]]  # texts that touch without a space
    begin[cut] = True
    stop[cut] = True
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    return start, end, np.searchsorted(start, at)
