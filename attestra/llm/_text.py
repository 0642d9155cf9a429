"""Vectorised word and window hashing over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 those
bytes never occur inside a longer character, so everything works on raw bytes.
Hashes are polynomial (Rabin-Karp) modulo 2**64 in two independent lanes, mixed
at the end of each level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SEQ = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
_LONG = 256
#: Text bytes handled at once inside a task.
SLICE_BYTES = 4 << 20
#: Stands for a null doc_id inside operators (such rows sort last and count as one document).
NULL_ID = (1 << 63) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array, by byte planes, so that high zero bytes compress."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    k = np.dtype(dtype).itemsize
    n = len(raw) // k
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k, n).T).view(dtype).reshape(n)


def strings(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most about ``limit`` bytes of ``col`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = strings(batch.column(batch.schema.get_field_index(col)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def ids(col) -> np.ndarray:
    """An integer column; null becomes NULL_ID."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True  # a document's words never run on into the next
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """One uint64 array per lane. Words over 256 bytes take a cryptographic digest instead."""
    n = end - start
    order = np.argsort(-np.minimum(n, _LONG + 1), kind="stable")
    s, length = start[order], n[order]
    long = int(np.searchsorted(-length, -_LONG, "left"))
    out = []
    most = int(length[long]) if long < len(length) else 0
    sizes = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # words of at least k bytes
    for lane in range(lanes):
        h = length.astype(np.uint64) + np.uint64(lane)
        for k in range(most):
            m = sizes[k]
            h[long:m] = h[long:m] * _BASES[lane] + (buf[s[long:m] + k].astype(np.uint64) + np.uint64(1))
        out.append(h)
    for i in range(long):
        d = hashlib.blake2b(buf[s[i] : s[i] + length[i]].tobytes(), digest_size=8 * lanes).digest()
        for lane in range(lanes):
            out[lane][i] = int.from_bytes(d[8 * lane : 8 * lane + 8], "little")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return [mix(h[back]) for h in out]


@lru_cache(maxsize=4)
def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    c = int(_SEQ[lane])
    full = lambda x: np.full(n, x, np.uint64)
    up, down = full(c), full(pow(c, -1, 1 << 64))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def window_hashes(w: np.ndarray, k: int, lane: int) -> np.ndarray:
    """Rabin-Karp hash of every ``k`` consecutive words: a difference of prefix sums times a power."""
    n = len(w)
    if n < k:
        return np.zeros(0, np.uint64)
    size = 1 << max(12, int(n + k).bit_length())
    up, down = _powers(lane, size)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(w * down[:n], out=pre[1:])
    return mix((pre[k:] - pre[:-k]) * up[k - 1 : n])
