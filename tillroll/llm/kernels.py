"""Vectorised byte kernels that run inside Arrow tasks.

They work on the concatenated UTF-8 bytes of a slice of rows, so no Python
object is made per word. A slice holds about ``SLICE_BYTES`` bytes. One longer
row is a slice of its own; inside it, what is as large as its bytes is made
piece by piece, and only places and hashes of its words are held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 mod 8: longest period mod 2**64
_BASE = (_BASE & ~7) | 5
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)

# words of the near-duplicate, language-model and fingerprint operators:
# everything but space and \t \n \v \f \r
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
# words of the decontamination operator: digits, a-z, all non-ASCII bytes
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_POW = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least ``n``."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = []
        for b in (_BASE, _INV):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:
                m = min(k, size - k)
                p[k:k + m] = p[:m] * _U(pow(b, k, 1 << 64))
                k += m
            out.append(p)
        _POW["p"], _POW["i"] = out
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, ob, db = a.buffers()
    offs = np.frombuffer(ob, np.int64, len(a) + 1, a.offset * 8) if ob else np.zeros(1, np.int64)
    data = np.frombuffer(db, np.uint8) if db else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; every row is whole."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (sorted, disjoint); ``value[b]`` is what
    byte ``b`` counts as, and must be 0 for bytes between the ranges. Ranges
    are hashed some ``SLICE_BYTES`` at a time, a longer one in pieces."""
    n = len(starts)
    out = np.zeros(n, np.uint64)
    i = 0
    while i < n:
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE_BYTES, "right")))
        b = int(ends[j - 1])
        pw, inv = _powers(min(b - a, SLICE_BYTES))
        if b - a <= SLICE_BYTES:
            c = value[buf[a:b]]
            c *= pw[:b - a]
            at = starts[i:j] - a
            out[i:j] = np.add.reduceat(c, at) * inv[at]
        else:
            total = 0
            for p in range(a, b, SLICE_BYTES):
                c = value[buf[p:min(p + SLICE_BYTES, b)]]
                c *= pw[:len(c)]
                total += int(c.sum(dtype=np.uint64)) * pow(_BASE, p - a, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, lower: bool = True):
    """Words of each row, after lower-casing A-Z unless not asked for:
    (hash, row, start, end). Bytes are looked at some ``SLICE_BYTES`` at a
    time, so that a long row needs little more than its words' places."""
    n = len(buf)
    if lower:
        is_word = is_word[LOWER]
        value = np.where(is_word, _TABLE[LOWER], _U(0))
    else:
        value = np.where(is_word, _TABLE, _U(0))
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(0, n, SLICE_BYTES):
        q = min(p + SLICE_BYTES, n)
        w = np.zeros(q - p + 2, bool)  # with the byte before and the one after
        a, b = max(p - 1, 0), min(q + 1, n)
        w[a - p + 1:b - p + 1] = is_word[buf[a:b]]
        first = np.zeros(q - p + 1, bool)
        first[offs[np.searchsorted(offs, p):np.searchsorted(offs, q, "right")] - p] = True  # no word runs across
        here = w[1:-1]
        starts.append(np.flatnonzero(here & (~w[:-2] | first[:-1])) + p)
        ends.append(np.flatnonzero(here & (~w[2:] | first[1:])) + p + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    h = range_hash(buf, starts, ends, value)
    rows = np.searchsorted(offs, starts, "right") - 1
    return h, rows, starts, ends


def chain_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries of ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, _U(n * 0xD6E8FEB86659FD93 % (1 << 64)))
    for k in range(n):
        out = (out ^ (out >> _U(29))) * _U(0x9FB21C651E98DF25) + h[k:k + m]
    return mix(out)


def pieces(buf: np.ndarray, offs: np.ndarray, special: bytes | None = None):
    """Cut rows where no byte-level pre-token can run across: before a space
    that follows a character which is not white space, and around each
    occurrence of ``special``. Returns (hash, row, start, end)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    for p in range(0, n, SLICE_BYTES):
        sp = np.flatnonzero(buf[p:p + SLICE_BYTES] == 0x20) + p
        sp = sp[sp > 0]
        p1 = buf[sp - 1]
        ok = NON_SPACE[p1] & ~((p1 >= 0x1C) & (p1 <= 0x1F))
        # after a multi-byte character: not after U+0085, U+00A0 or any
        # character that may be one of the white-space characters from U+1680 on
        p2, p3 = buf[np.maximum(sp - 2, 0)], buf[np.maximum(sp - 3, 0)]
        wide = p1 >= 0x80
        ok &= ~(wide & (((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3))))
        cut[sp[ok]] = True
    if special:
        whole, at = buf.tobytes(), -1
        while (at := whole.find(special, at + 1)) >= 0:
            r = np.searchsorted(offs, at, "right")
            if at + len(special) <= offs[r]:
                cut[at] = cut[at + len(special)] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], n)
    h = range_hash(buf, starts, ends, _TABLE)
    rows = np.searchsorted(offs, starts, "right") - 1
    return h, rows, starts, ends


def take_ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[0].. begin[0]+count[0]-1, begin[1].., concatenated."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(begin - at, count)
