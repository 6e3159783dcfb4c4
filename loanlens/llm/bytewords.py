"""Vectorised word work on the raw UTF-8 buffers of Arrow string columns.

A column's texts lie back to back in one byte buffer. Words are runs of bytes
of a class (a 256-entry table), found with whole-buffer numpy passes; a word's
64-bit hash is a polynomial in its bytes, from prefix sums modulo 2**64. Word
arrays are about a sixth of the text; the 8-bytes-per-character passes work on
segments of bounded size, so a very long text needs no more memory than its
own words.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19


def byte_class(pattern: str) -> np.ndarray:
    """Word-byte table. ``alnum``: 0-9 a-z and every non-ASCII byte (texts
    lower-cased first); ``nonspace``: all but space and \\t \\n \\v \\f \\r;
    ``letter``: a-z and non-ASCII."""
    t = np.zeros(256, bool)
    if pattern == "nonspace":
        t[:] = True
        t[[32, 9, 10, 11, 12, 13]] = False
        return t
    t[97:123] = True
    t[128:] = True
    if pattern == "alnum":
        t[48:58] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system: two workers share an executor's
    memory with its JVM, and freed batches would stay with the worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):       # not glibc
        ctypes.CDLL(None).malloc_trim(0)


BATCH = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(frame):
    """``frame``, whose session now sends its Arrow tasks batches of about 1 MB
    (a session-wide setting; a smaller one stays). Spark's default of 64 MB is
    held twice, by the JVM and by the Python worker, for every task."""
    conf = frame.sparkSession.conf
    now = frame.sparkSession.sql(f"SET {_BATCH_CONF}").first()["value"]
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH or int(now.rstrip("b")) <= 0:
        conf.set(_BATCH_CONF, str(BATCH))
    return frame


def slices(table, limit: int = 1 << 20, column: str = "text", rows: int = 1 << 16):
    """Row slices of a record batch with about ``limit`` text bytes each (one
    longer text stands alone) and at most ``rows`` rows."""
    data, offsets = buffers(table.column(column))
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, lo + rows, max(hi, lo + 1))
        yield table.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi
    del data, offsets
    release()


def find_words(data: np.ndarray, offsets: np.ndarray, cls: np.ndarray):
    """(starts, ends, first): byte ranges of the words in order, and per text
    the index of its first word (one entry more than texts)."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    w = cls[data]
    head = np.zeros(n + 1, bool)
    head[0] = True
    head[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | head[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    head[n] = True
    ends = np.flatnonzero(w & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int):
    import sys
    cache = sys.__dict__.setdefault("_loanlens_powers", {})
    if "p" not in cache or len(cache["p"][0]) < n:
        with np.errstate(over="ignore"):
            r = np.uint64(0x9E3779B97F4A7C15)
            inv = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            p, q = np.full(n, r), np.full(n, inv)
            p[0] = q[0] = 1
            cache["p"] = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return cache["p"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        if hi <= lo:      # one word longer than a segment: fold its segments
            h = np.uint64(0)
            for a in range(int(starts[lo]), int(ends[lo]), SEGMENT):
                b = min(a + SEGMENT, int(ends[lo]))
                with np.errstate(over="ignore"):
                    p, _ = _powers(SEGMENT + 1)
                    s = np.sum(BYTE_VALUES[data[a:b]] * p[:b - a], dtype=np.uint64)
                    h = mix(np.array([h + s], np.uint64))[0]
            out[lo] = h
            lo += 1
            continue
        seg = data[base:ends[hi - 1]]
        p, q = _powers(SEGMENT + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[seg] * p[:len(seg)], dtype=np.uint64, out=s[1:])
            a, b = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (s[b] - s[a]) * q[a]
        lo = hi
    return mix(out)


def kgrams(h: np.ndarray, first: np.ndarray, k: int):
    """(hash, word index of its first word, text index) of every run of ``k``
    words that stays inside one text."""
    n = len(h)
    if n < k:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e
    m = n - k + 1
    g = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[j:j + m]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(doc[:m] == doc[k - 1:])
    return mix(g[ok]), ok, doc[ok]


def winnow(g: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Indices of the fingerprints: the smallest hash (rightmost on ties) of
    every ``w`` consecutive k-grams of a text; a text with fewer k-grams is one
    window. Any run of w consecutive k-grams that two texts share selects the
    same k-gram in both."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    if w <= 1:
        return np.arange(n)
    picked = np.zeros(n, bool)
    m = n - w + 1
    if m > 0:
        for lo in range(0, m, 1 << 18):
            hi = min(m, lo + (1 << 18))
            view = np.lib.stride_tricks.sliding_window_view(g[lo:hi + w - 1], w)
            at = np.arange(lo, hi) + (w - 1) - view[:, ::-1].argmin(axis=1)
            picked[at[doc[lo:hi] == doc[lo + w - 1:hi + w - 1]]] = True
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.r_[heads, n])
    for a, s in zip(heads[sizes < w], sizes[sizes < w]):
        picked[a + s - 1 - g[a:a + s][::-1].argmin()] = True
    return np.flatnonzero(picked)


def winnow_wide(g: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """The same as ``winnow``, by doubling: the smallest of a window of 2n comes
    from those of two windows of n, so the work grows with the logarithm of w."""
    n = len(g)
    m = n - w + 1
    picked = np.zeros(n, bool)
    for lo in range(0, max(m, 0), 1 << 16):
        hi = min(m, lo + (1 << 16))
        value, at, size = g[lo:hi + w - 1], np.arange(lo, hi + w - 1), 1
        while size < w:
            step = min(size, w - size)
            right = value[step:] <= value[:-step]
            value = np.where(right, value[step:], value[:-step])
            at = np.where(right, at[step:], at[:-step])
            size += step
        picked[at[doc[lo:hi] == doc[lo + w - 1:hi + w - 1]]] = True
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    for a, s in zip(heads[sizes < w], sizes[sizes < w]):
        picked[a + s - 1 - g[a:a + s][::-1].argmin()] = True
    return np.flatnonzero(picked)


def kgrams_wide(h: np.ndarray, first: np.ndarray, k: int):
    """The same as ``kgrams``, by doubling: the hash of a + b words comes from
    those of a words and of the b words after them."""
    n = len(h)
    if n < k:
        return kgrams(h, first, k)
    base, m = 0xD6E8FEB86659FD93, n - k + 1
    g, size, part, width = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                # the runs taken so far come after those of this width
                g = part if g is None else part[:n - size - width + 1] * np.uint64(pow(base, size, 1 << 64)) \
                    + g[width:n - size + 1]
                size += width
            if size == k:
                break
            end = n - 2 * width + 1
            part = part[:end] * np.uint64(pow(base, width, 1 << 64)) + part[width:end + width]
            width *= 2
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(doc[:m] == doc[k - 1:])
    return mix(g[ok]), ok, doc[ok]
