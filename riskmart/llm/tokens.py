"""Word and shingle hashes of whole Arrow string columns with numpy.

A word's 64-bit hash is a polynomial in its bytes over the integers modulo 2^64,
taken from one running sum over the buffer and then mixed, so a block of texts
costs a few array passes instead of one Python step per word. Texts of any length
are read in chunks that end between words, so memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def byte_table(word_bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(word_bytes)] = True
    return t


#: Words are maximal runs of bytes other than space and \t \n \v \f \r.
NOT_SPACE = byte_table(set(range(256)) - {0x20, 9, 10, 11, 12, 13})
#: Words are runs of digits, ASCII letters and non-ASCII bytes.
ALNUM = byte_table(set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B))
                   | set(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ``buf`` is one chunk."""
    up, down = _powers(len(buf))
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=run[1:])
    h = (run[end] - run[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray,
          lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word and, per text, the index of its
    first word (one entry more than texts). A word never spans two texts."""
    n = len(buf)
    hs, ss, es = [], [], []
    edges = offsets[1:-1]
    at = 0
    while at < n:
        stop = min(at + CHUNK, n)
        if stop < n:
            inside = buf[at:stop]
            gaps = np.flatnonzero(~is_word[inside])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:                       # one word longer than a chunk: go to its end
                k = int(np.searchsorted(edges, at, side="right"))
                limit = int(edges[k]) if k < len(edges) else n
                while stop < limit and is_word[buf[stop]]:
                    tail = np.flatnonzero(~is_word[buf[stop:min(stop + CHUNK, limit)]])
                    stop = stop + int(tail[0]) if len(tail) else min(stop + CHUNK, limit)
        part = buf[at:stop]
        w = is_word[part]
        first = np.empty(len(w), dtype=bool)
        first[0] = True
        first[1:] = ~w[:-1]
        k0, k1 = np.searchsorted(edges, [at, stop])
        local = edges[k0:k1] - at
        first[local] = True
        s = np.flatnonzero(w & first)
        last = np.empty(len(w), dtype=bool)
        last[-1] = True
        last[:-1] = ~w[1:]
        last[local[local > 0] - 1] = True
        e = np.flatnonzero(w & last) + 1
        if len(s):
            hs.append(span_hashes(LOWER[part] if lower else part, s, e))
            ss.append(s + at)
            es.append(e + at)
        at = stop
    if not hs:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    start = np.concatenate(ss)
    return np.concatenate(hs), start, np.concatenate(es), np.searchsorted(start, offsets)


def text_blocks(column: pa.Array, max_bytes: int = CHUNK):
    """Runs of rows of a string or binary column with at most ``max_bytes`` of
    text each (one row may be longer): (first row, end row, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type)
                             else pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        # a null may leave stale bytes; give it an empty range of its own
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
        yield from text_blocks(column, max_bytes)
        return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, raw[a:b], offsets[lo:hi + 1] - a
        lo = hi


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
        0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def odd(j: int) -> np.uint64:
    """An odd 64-bit constant for place ``j``."""
    return np.uint64((_ODD[j % 6] * (2 * (j // 6) + 1) | 1) & _M64)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int):
    """Per text the sorted distinct hashes of its ``k``-word shingles; a text of
    fewer words gives its whole sequence as one; one without words gives none."""
    n = len(h)
    if n >= k:
        s = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            s = (s + mix(h[j:n - k + 1 + j] ^ odd(j))) * odd(j + 1)
        s = mix(s)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield d, np.unique(s[a:b - k + 1])
        elif b > a:
            x = np.full(1, b - a, dtype=np.uint64)
            for j in range(a, b):
                x = mix((h[j:j + 1] ^ odd(j - a)) + x * odd(b - a))
            yield d, x
        else:
            yield d, np.empty(0, dtype=np.uint64)
