"""Periodic runs of words by a sparse diagonal dynamic programme.

On the diagonal of lag q, the match length of word i is one more than that of
word i-1 if word i equals word i-q, and else 0. A run of smallest period q is a
stretch on that diagonal with enough matches. Only cells that can belong to a
run are ever filled:

- A run of lag q has at least max(q, shortest - q) matches, so a cell counts only
  as the end of a gram of that many equal words. Lags are taken in classes
  that double, each with grams as long as its smallest lag; a word's earlier
  cells are then the few earlier places of its gram inside the class.
- Places inside a run that is already emitted, at a multiple of its period,
  lie on diagonals that end where that run ends. They are passed over.
- A class whose cells do not fit is cut into ranges of lags. Diagonals do not
  depend on each other, so a range is done when it is read, and its runs are
  emitted.

Memory is bounded by the slice of texts and by ``CELLS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

SHORTEST = 12  # words of the shortest run
CELLS = 1 << 21  # cells of the programme that are held at once


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; it doubles up, so long
    grams cost log(size) steps."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        m = len(h) - have - step + 1
        out = K.mix(out[:m] * np.uint64(0x9E3779B97F4A7C15) + K.mix(out[step:step + m] + np.uint64(have + step)))
        have += step
    return out


def _diagonals(lag: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (lag, end of a matching gram) -> stretches (start, end, lag),
    both ends included: consecutive cells of a diagonal add one match each."""
    order = np.lexsort((end, lag))
    lag, end = lag[order], end[order]
    new = np.ones(len(lag), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (end[1:] != end[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lag)) - 1
    q = lag[first]
    return end[first] - size + 1 - q, end[last], q


def find_runs(h: np.ndarray, cut: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the word hashes ``h`` of texts that begin at ``cut`` (last
    entry: the end): (start, length, period), by start, then period."""
    sizes = np.diff(cut)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = h ^ K.mix(text.astype(np.uint64) + np.uint64(1))  # equal words of two texts differ
    head = np.full(len(h), -1, np.int64)  # start of an emitted run around the gram that ends here
    alive = np.arange(len(h))  # places whose gram of the class before occurs twice
    runs: dict[tuple[int, int], int] = {}
    low, high = 1, shortest
    while len(alive) and low <= sizes.max() // 2:
        size = max(low, (shortest + 1) // 2)
        end = alive[alive - size + 1 >= cut[text[alive]]]
        g = _grams(own, size)[end - size + 1]
        if low >= shortest:
            for s, e in runs:  # grams inside the run
                a, b = s + size - 1, e + 1
                if b > a:
                    old = head[a:b]
                    head[a:b] = np.where(old < 0, s, np.minimum(old, s))
        # equal grams side by side, by place
        order = np.argsort(g, kind="stable")
        g, end = g[order], end[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1
        group, end = group[several], end[several]
        alive = np.sort(end)
        width = len(h) + 2 * high
        key = group * width + end
        least = end - low
        inside = head[end] >= 0
        least[inside] = np.minimum(least[inside], head[end[inside]] + size - 2)
        a = np.searchsorted(key, group * width + np.maximum(end - high + 1, 0))
        b = np.maximum(np.searchsorted(key, group * width + np.maximum(least, -1), "right"), a)
        b[least < 0] = a[least < 0]
        for i, j in _lag_ranges(end, a, b, low, high):
            lo = np.maximum(a, np.searchsorted(key, group * width + np.maximum(end - j + 1, 0)))
            hi = np.minimum(b, np.searchsorted(key, group * width + np.maximum(end - i, -1), "right"))
            count = np.where(end >= i, np.maximum(hi - lo, 0), 0)
            if not count.any():
                continue
            here = np.repeat(end, count)
            lag = here - end[K.take_ranges(lo, count)]
            s, e, q = _diagonals(lag, here, size)
            ok = e - s + 1 >= np.maximum(2 * q, shortest)
            for s, e, q in zip(s[ok].tolist(), e[ok].tolist(), q[ok].tolist()):
                runs[s, e] = min(q, runs.get((s, e), q))
        low, high = high, 2 * high
        if low >= shortest:
            head[:] = -1
    out = np.array(sorted((s, q, e - s + 1) for (s, e), q in runs.items()), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _lag_ranges(end: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Cuts the lags from ``low`` to ``high`` into ranges of few cells."""
    cells = int((b - a).sum())
    if not cells:
        return
    step = max(1, (high - low) * CELLS // max(cells, 1))
    for i in range(low, high, step):
        yield i, min(i + step, high)


def dropped_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of the words as they are written, and the first
    word of each text."""
    h, rows, begin, end = K.words(buf, offs, K.NON_SPACE, lower=False)
    return h, begin, end, np.searchsorted(rows, np.arange(len(offs)))


def _joined(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(begin):
        return b""
    out = np.full(int((end - begin).sum()) + len(begin) - 1, 0x20, np.uint8)
    size = end - begin
    to = np.cumsum(size + 1) - size - 1
    out[K.take_ranges(to, size)] = buf[K.take_ranges(begin, size)]
    return out.tobytes()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
                  collapsed: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` (start, length,
    period: in words, by start, then period), ``collapsed`` (the words that
    no run contains after its first period, joined by one space; null unless
    asked for) and ``collapsed_sha256`` (if asked for).

    Words are what lies between spaces and \\t \\n \\v \\f \\r, compared as
    written. A run is a maximal stretch with smallest period q (words q apart
    are equal) and a length of at least max(``shortest``, 2 q). Runs may
    overlap; several can have the same start.

    A null, empty or word-less text has no runs and collapses to the empty
    text. A null id stays null; repeated rows give repeated results; an empty
    table gives an empty one. Other columns are not read.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType()),
                           T.StructField("collapsed_sha256", T.StringType())])

    def rows(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        h, begin, end, cut = _words(buf, offs)
        start, length, period = find_runs(h, cut, shortest)
        drop = dropped_words(len(h), start, length, period)
        texts, shas = [], []
        for i, j in zip(cut[:-1], cut[1:]):
            keep = np.flatnonzero(~drop[i:j]) + i
            text = _joined(buf, begin[keep], end[keep]) if collapsed or digests else b""
            texts.append(text.decode() if collapsed else None)
            shas.append(hashlib.sha256(text).hexdigest() if digests else None)
        of = np.searchsorted(start, cut)
        first = np.repeat(cut[:-1], np.diff(of))
        cells = pa.StructArray.from_arrays([pa.array(start - first), pa.array(length), pa.array(period)],
                                           names=["start", "length", "period"])
        return [pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), cells),
                pa.array(texts, pa.string()), pa.array(shas, pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(1))
            for i, j in K.slices(offs):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *rows(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.drop(*[c for c, on in (("collapsed", collapsed), ("collapsed_sha256", digests)) if not on]).withColumnRenamed("id", id_col)
