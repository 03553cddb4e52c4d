"""Vectorised text kernels shared by the operators of this folder.

A batch of texts is one byte buffer plus offsets (an Arrow string column as it
is), and every kernel is a handful of numpy passes over that buffer: there is
no Python loop over words or characters.  ``slices`` cuts an Arrow batch into
pieces of bounded bytes so that the eight-byte scratch arrays stay small
whatever the batch holds; one text is never cut.

Memory: a slice is ``SLICE_BYTES`` or one longer text, and the arrays of a pass
take 50 to 80 bytes for each of its bytes, so a worker with 2 GB reads texts of
up to about 25 MB.  (``suffix_dedup`` reads longer ones in pieces.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: ASCII white space: 0x20 and 0x09-0x0D; everything else is part of a word.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text handled at once (a longer text is handled alone).
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

U64 = np.uint64


@dataclass
class Texts:
    """A slice of a text column: bytes, and len(off) - 1 texts."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, off - off[0])


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of consecutive runs of rows of about ``limit`` bytes."""
    whole = texts_of(batch.column(batch.schema.get_field_index(name)))
    at, n = 0, len(whole)
    while at < n:
        end = int(np.searchsorted(whole.off, whole.off[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        off = whole.off[at : end + 1]
        yield at, end, Texts(whole.buf[off[0] : off[-1]], off - off[0])
        at = end


def release() -> None:
    """Give memory that a worker no longer uses back to the system: idle workers count against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker keeps from task to task, by name; a task of another kind frees it.
HELD: dict[str, tuple] = {}


def _forget(keep: str) -> None:
    for name in [n for n in HELD if n != keep]:
        del HELD[name]
        release()


def tidy(task: Callable, keep: str = "") -> Callable:
    """A task over Arrow batches that frees what other tasks kept, but for ``keep``, and releases memory when it ends."""

    @wraps(task)
    def run(batches):
        _forget(keep)
        try:
            yield from task(batches)
        finally:
            release()

    return run


def tidy_group(task: Callable) -> Callable:
    """A function of one Arrow table that releases memory after each."""

    @wraps(task)
    def run(table):
        _forget("")
        try:
            return task(table)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (in a new array)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[k : k + 1] = [p]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with hash(buf[i:j]) = (S[j] - S[i]) * base**-i."""
    up, _ = _pow(len(buf) + 1)
    s = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + U64(1)) * up[:-1], out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span; equal bytes give equal hashes at any place."""
    _, down = _pow(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a slice: byte spans, the text each is in, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def words(t: Texts) -> Words:
    n = len(t.buf)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, np.zeros(len(t) + 1, np.int64))
    space = IS_SPACE[t.buf]
    inside = ~space
    full = t.off[:-1] < t.off[1:]
    begins, ends = np.ones(n, bool), np.ones(n, bool)
    begins[1:], ends[:-1] = space[:-1], space[1:]
    begins[t.off[:-1][full]] = True
    ends[t.off[1:][full] - 1] = True
    start = np.flatnonzero(inside & begins)
    end = np.flatnonzero(inside & ends) + 1
    first = np.searchsorted(start, t.off)
    return Words(start, end, np.repeat(np.arange(len(t)), np.diff(first)), first)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return buf + np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words within a text, and the text of each run.

    A text with fewer words, but one, has its whole sequence as its only run.
    """
    n = np.diff(first)
    total = len(h)
    out = np.zeros(total, dtype=np.uint64)
    room = np.minimum(width, np.maximum(0, np.repeat(first[1:], n) - np.arange(total)))
    for k in range(width):
        part = np.zeros(total, dtype=np.uint64)
        part[: total - k] = h[k:] if k else h
        out = np.where(room > k, mix(out * U64(0x9FB21C651E98DF25) + part + U64(k + 1)), out)
    at = np.arange(total) - np.repeat(first[:-1], n)
    length = np.repeat(n, n)
    keep = (at + width <= length) | ((length < width) & (at == 0))
    doc = np.repeat(np.arange(len(n)), n)
    return out[keep], doc[keep]


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive runs given by ``first`` (empty runs: 0)."""
    s = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=s[1:])
    return s[first[1:]] - s[first[:-1]]


def earlier_equal(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same key occurred before within the same text (doc ascending)."""
    if not len(key):
        return np.zeros(0, bool)
    k = mix(key ^ mix(doc.astype(np.uint64) + U64(0x51ED27)))
    order = np.argsort(k, kind="stable")
    same = np.zeros(len(k), bool)
    same[1:] = k[order][1:] == k[order][:-1]
    out = np.zeros(len(k), bool)
    out[order] = same
    return out


def in_repeat(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same key occurs twice or more within the same text."""
    if not len(key):
        return np.zeros(0, bool)
    k = mix(key ^ mix(doc.astype(np.uint64) + U64(0x51ED27)))
    order = np.argsort(k)
    eq = k[order][1:] == k[order][:-1]
    same = np.zeros(len(k), bool)
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), bool)
    out[order] = same
    return out
