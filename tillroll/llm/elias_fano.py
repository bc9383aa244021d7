"""Elias-Fano sequences on (memory-mapped) arrays, with vectorised access."""

from __future__ import annotations

import numpy as np

_BLOCK = 16  # bytes of upper bits per directory entry
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)  # place of the k-th one bit, lowest first
for _b in range(256):
    for _k, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _p


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of ``width`` bits, as bytes (with 8 spare ones)."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    out = []
    for i in range(0, len(values), 1 << 15):  # 2**15 fields fill whole bytes
        v = values[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(v, axis=1, bitorder="little")[:, :width].reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The fields at the given places."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    byte = bit >> 3
    v = data[byte[:, None] + np.arange(8)].view("<u8").reshape(-1) >> (bit & 7).astype(np.uint64)
    if width > 57:
        raise ValueError("fields of at most 57 bits")
    return v & np.uint64((1 << width) - 1)


def split_width(n: int, top: int) -> int:
    return max(0, (top // max(n, 1)).bit_length() - 1) if n else 0


def build(values: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence; ``values`` do not decrease and are <= top."""
    n = len(values)
    width = split_width(n, top)
    v = values.astype(np.uint64)
    high = (v >> np.uint64(width)).astype(np.int64)
    bits = np.zeros(n + (top >> width) + 1, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little")
    upper = np.append(upper, np.zeros(-len(upper) % _BLOCK + _BLOCK, np.uint8))
    ones = _POP[upper].reshape(-1, _BLOCK).sum(1, dtype=np.int64)
    before = np.append(0, np.cumsum(ones)[:-1])
    zeros = np.arange(len(before)) * _BLOCK * 8 - before
    return {"n": np.array([n, width]), "low": pack(v & np.uint64((1 << width) - 1), width), "upper": upper,
            "ones": before, "zeros": zeros}


def values(s: dict[str, np.ndarray]) -> np.ndarray:
    """The whole sequence."""
    n, width = int(s["n"][0]), int(s["n"][1])
    high = np.flatnonzero(np.unpackbits(s["upper"], bitorder="little")) - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(width)) | unpack(s["low"], width, np.arange(n))


def _select(s: dict[str, np.ndarray], k: np.ndarray, one: bool) -> np.ndarray:
    """Bit place of the k-th one (zero) of the upper bits."""
    before = s["ones"] if one else s["zeros"]
    blk = np.searchsorted(before, k, "right") - 1
    rest = (k - before[blk]).astype(np.uint8)  # a block has 128 bits
    cells = s["upper"].reshape(-1, _BLOCK)[blk]
    if not one:
        cells = ~cells
    upto = np.cumsum(_POP[cells], axis=1, dtype=np.uint8)
    byte = (upto <= rest[:, None]).sum(1, dtype=np.uint8).astype(np.int64)
    rows = np.arange(len(k))
    rest -= np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0).astype(np.uint8)
    return blk * (_BLOCK * 8) + byte * 8 + _SELECT[cells[rows, byte], rest]


def get(s: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Entries at the given places."""
    width = int(s["n"][1])
    high = _select(s, at, True) - at
    return (high.astype(np.uint64) << np.uint64(width)) | unpack(s["low"], width, at)


def successor(s: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first entry >= x and whether it equals x, for a strictly
    increasing sequence and x <= top."""
    n, width = int(s["n"][0]), int(s["n"][1])
    high = (x >> np.uint64(width)).astype(np.int64)
    low = x & np.uint64((1 << width) - 1)
    # entries with this high part: between the zero that opens it and its own
    begin = np.where(high > 0, _select(s, np.maximum(high - 1, 0), False) - (high - 1), 0)
    end = _select(s, high, False) - high
    lo, hi = begin.copy(), end.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) >> 1
        less = unpack(s["low"], width, mid) < low[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    same = lo < end
    k = np.flatnonzero(same)
    same[k] = unpack(s["low"], width, lo[k]) == low[k]
    return np.minimum(lo, n), same
