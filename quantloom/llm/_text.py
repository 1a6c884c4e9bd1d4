"""Vectorised text kernels: numpy over the bytes of an Arrow batch, no Spark.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All hashes are 64-bit,
seeded by constants, so every executor computes the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply); a bijection."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))

#: Spans over so many bytes are hashed and compared one by one.
LONG = 64
_MASK = np.append((U(1) << (U(8) * np.arange(8, dtype=U))) - U(1), ~U(0))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, U), np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    global _pow
    if len(_pow[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())

        def run(base: int) -> np.ndarray:
            out = np.ones(m, U)
            k = 1
            step = U(base)
            while k < m:
                out[k : 2 * k] = out[:k] * step
                step = step * step
                k *= 2
            return out

        with np.errstate(over="ignore"):
            _pow = run(_BASE), run(_BASE_INV)
    return _pow[0][:n], _pow[1][:n]


def trim() -> None:
    """Give freed memory back to the system: Python workers live on and share the executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(text: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) in runs of at most ``max_bytes``, or one longer text; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    n = len(text)
    if not n:
        return
    bufs = text.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def edges(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of True bytes; runs end where documents do."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first = first[:n]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of a chunk."""
    return edges(~SPACE[data], offs)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes starts[i]..ends[i]; equal bytes give equal values anywhere.

    Eight bytes at a time, each step a bijection; long spans by xxh3.
    """
    size = ends - starts
    out = mix(size.astype(U) + U(0x5851F42D4C957F2D))
    eight = _eights(data)
    at = np.flatnonzero(size <= LONG)
    k = 0
    while len(at := at[size[at] > k]):
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
        k += 8
    at = np.flatnonzero(size > LONG)
    if len(at):
        raw = memoryview(np.ascontiguousarray(data))
        out[at] = [xxhash.xxh3_64_intdigest(raw[a:e]) for a, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct span the first one's number, and for every span the place among these; bytes decide, not hashes."""
    _, first, own = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    size, lead = ends - starts, first[own]
    eight = _eights(data)
    same = size == size[lead]
    at = np.flatnonzero(same & (size <= LONG) & (lead != np.arange(len(lead))))
    k = 0
    while len(at := at[size[at] > k]):
        same[at] &= (eight[starts[at] + k] ^ eight[starts[lead[at]] + k]) & _MASK[np.minimum(size[at] - k, 8)] == 0
        k += 8
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(same & (size > LONG) & (lead != np.arange(len(lead)))).tolist():
        same[i] = raw[starts[i] : ends[i]] == raw[starts[lead[i]] : ends[lead[i]]]
    wrong = np.flatnonzero(~same)
    if len(wrong):  # equal hashes of different bytes
        more: dict[bytes, int] = {}
        for i in wrong.tolist():
            own[i] = len(first) + more.setdefault(bytes(raw[starts[i] : ends[i]]), len(more))
        first = np.concatenate((first, wrong[np.unique(own[wrong], return_index=True)[1]]))
    return first, own


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every place on; it picks places and never says that bytes are equal."""
    prefix = np.zeros(len(data) + 1, U)
    power, inverse = _powers(len(data) + 1)
    np.cumsum(_TABLE[data] * power[:-1], out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * inverse[: len(data) - width + 1])


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their documents; a shorter document gives its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs)
    if not len(h):
        return h, doc
    roll = np.zeros(max(0, len(h) - size + 1), U)
    for k in range(size):
        roll = mix(roll * U(0x9FB21C651E98DF25) + h[k : len(h) - size + 1 + k]) if len(roll) else roll
    keep = doc[: len(roll)] == doc[size - 1 :] if len(roll) else np.zeros(0, bool)
    out, at = roll[keep], doc[: len(roll)][keep]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))[short]
        value = np.full(len(short), 0x1234567, U)
        for k in range(size - 1):
            on = count[short] > k
            value[on] = mix(value[on] * U(0xC2B2AE3D27D4EB4F) + h[first[on] + k])
        out, at = np.concatenate((out, value)), np.concatenate((at, short))
    return out, at


def distinct_by_doc(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes document after document, and the n_docs + 1 offsets."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs))))
