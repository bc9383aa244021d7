"""Removal of byte strings that repeat anywhere in the corpus.

A string of ``length`` bytes is repeated when it also starts at another place,
in the same or another document. The suffixes that matter are few:

1. Every window of ``length`` bytes has one anchor, the leftmost of its
   ``GRAM``-byte strings with the smallest hash. Equal windows have equal
   anchors at equal places, so only suffixes at anchors need sorting. A
   *region* is the run of windows with one anchor; it has the anchor's hash
   ``h`` and a hash ``rh`` of all its bytes.
2. Regions whose anchor occurs once are dropped. Regions that occur as a whole
   more than once are repeated as a whole, and go on as one representative.
3. Per anchor, the different regions form a bucket of suffixes that share
   their first ``GRAM`` bytes. Spark sorts them by the bytes right of the
   anchor, which is the enhanced suffix array's order. The common prefixes of
   neighbours are stack-scanned into the common-prefix interval tree. In each
   interval the left sides are tested for diversity: where they differ, the
   members are ordered by their left sides too, and each gets its longest left
   extension shared inside the interval. Left and right extension together
   give the maximal repeats of at least ``length`` bytes and all their
   occurrences, not just neighbours.
4. A bucket of more than ``BUCKET`` different regions (a passage that very many
   documents share) is not gathered in a task. Its windows are counted by
   hash with combining before the shuffle, which gives the same extents.
5. The spans of a document are merged and cut out.

Strings are compared by bytes inside a bucket and by 64-bit hashes elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import stored

GRAM = 64
BUCKET = 4096  # about 2 MB of regions in one task


def regions(buf: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM):
    """Regions of a slice: (row, start, end, size, anchor offset, h, rh, times).
    Equal neighbouring regions (periodic text) are one entry with ``times``
    over 1 that ends where the last of them ends."""
    n = len(buf)
    empty = tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    if n < length:
        return empty
    pw, inv = K._powers(n)
    c = K._TABLE[buf]
    c *= pw[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(c, out=total[1:])
    m = n - gram + 1
    h = K.mix((total[gram:] - total[:m]) * inv[:m])
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    w, span = length - gram + 1, 1
    while span * 2 <= w:  # smallest key of each w neighbours: leftmost smallest hash
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[:len(key) - (w - span)], key[w - span:])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one row
    first, last = offs[:-1], offs[1:] - length
    ok = last >= first
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, last[ok] + 1, -1)
    win = np.flatnonzero(np.cumsum(inside[:len(at)]) > 0)
    if not len(win):
        return empty
    rows = np.searchsorted(offs, win, "right") - 1
    a = at[win]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (rows[1:] != rows[:-1])))
    start = win[new]
    end = np.append(win[new[1:] - 1], win[-1]) + length
    anchor, row = a[new], rows[new]
    size = end - start
    rh = K.mix((total[end] - total[start]) * inv[start] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hh = h[anchor]
    fresh = np.append(True, (rh[1:] != rh[:-1]) | (hh[1:] != hh[:-1]) | (row[1:] != row[:-1]))
    k = np.flatnonzero(fresh)
    times = np.diff(np.append(k, len(row)))
    stop = end[k + times - 1]
    return (row[k], start[k] - offs[row[k]], stop - offs[row[k]], size[k], (anchor - start)[k], hh[k], rh[k], times)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): k1 and k2 are two hashes of the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"),
                       F.xxhash64(F.lit(7), text).alias("k2"))


def _anchored(src: DataFrame, length: int) -> DataFrame:
    names = ["a", "b", "size", "off", "h", "rh", "times"]
    schema = T.StructType([src.schema["id"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                           *[T.StructField(x, T.LongType()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(1))
            for i, j in K.slices(offs):
                row, *cols = regions(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], length)
                idx = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(idx) for c in (0, 2, 3)] + [pa.array(c.view(np.int64)) for c in cols],
                    names=schema.names)

    return src.mapInArrow(run, schema)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common prefix length of each pair of rows (padding differs)."""
    ne = x != y
    return np.where(ne.any(1), ne.argmax(1), x.shape[1])


def _padded(parts: list[bytes], pads: tuple[int, int]) -> np.ndarray:
    """Rows as int16; the padding never equals a byte, nor another row's."""
    width = max(1, max(map(len, parts)))
    out = np.empty((len(parts), width), np.int16)
    out[:] = np.where(np.arange(len(parts)) % 2, pads[0], pads[1])[:, None]
    for i, p in enumerate(parts):
        out[i, :len(p)] = np.frombuffer(p, np.uint8)
    return out


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) by a stack scan; lcp[i] is
    that of entries i and i + 1."""
    stack: list[list[int]] = []
    for i, d in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            yield depth, first, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append([d, first])


def extents(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int]]:
    """Of each suffix of a bucket, how far its repeats of at least ``length``
    bytes reach left and right of the anchor; (0, 0) where it has none.
    ``right`` is sorted."""
    n = len(left)
    back = [x[::-1] for x in left]
    order = sorted(range(n), key=back.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rlen = np.array([len(x) for x in right])
    llen = np.array([len(x) for x in left])
    rp, lp = _padded(right, (-1, -2)), _padded(back, (-1, -2))

    def shared(m: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(_common(m[x], m[y]), np.minimum(size[x], size[y]))

    seq = np.arange(n)
    lcp = shared(rp, rlen, seq[:-1], seq[1:])
    far_l, far_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for depth, a, b in intervals(lcp):
        who = seq[a:b + 1]
        who = who[np.argsort(rank[who])]
        near = shared(lp, llen, who[:-1], who[1:])  # 0 everywhere: fully left-diverse
        best = np.maximum(np.append(near, 0), np.append(0, near))
        ok = best + depth >= length
        far_l[who[ok]] = np.maximum(far_l[who[ok]], best[ok])
        far_r[who[ok]] = np.maximum(far_r[who[ok]], depth)
    return list(zip(far_l.tolist(), far_r.tolist()))


def _in_buckets(reg: DataFrame, length: int) -> DataFrame:
    """(h, rh, lo, hi): repeated bytes of the single regions of small buckets,
    from the region's start."""
    src = (reg.select("h", "rh", "n", "off", F.col("bytes"), F.expr("substring(bytes, off + 1)").alias("right"))
           .repartition("h").sortWithinPartitions("h", "right", "rh"))

    def bucket(h, rows):
        left = [x[3][:x[2]] for x in rows]
        right = [x[3][x[2]:] for x in rows]
        for (lf, rt), (rh, n, off, _) in zip(extents(left, right, length), rows):
            if rt and n == 1:
                yield h, rh, off - lf, off + rt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen, out = None, [], set(), []

        def flush():
            if len(rows) > 1:
                out.extend(bucket(now, rows))

        for b in batches:
            d = [b.column(k).to_pylist() for k in range(5)]
            for h, rh, n, off, data in zip(*d):
                if h != now:
                    flush()
                    now, rows, seen = h, [], set()
                if rh not in seen:
                    seen.add(rh)
                    rows.append((rh, n, off, data))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["h", "rh", "lo", "hi"])
                out = []
        flush()
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "rh", "lo", "hi"])

    return src.select("h", "rh", "n", "off", "bytes").mapInArrow(run, "h long, rh long, lo long, hi long")


def _by_windows(reg: DataFrame, length: int) -> DataFrame:
    """The same for large buckets, by counting the hashes of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                cells = part.column(2).to_pylist()
                size = np.array([len(x) for x in cells])
                per = size - length + 1
                buf = np.frombuffer(b"".join(cells), np.uint8)
                pw, inv = K._powers(len(buf))
                total = np.append(np.uint64(0), np.cumsum(K._TABLE[buf] * pw[:len(buf)]))
                at = K.take_ranges(np.cumsum(size) - size, per)
                h = K.mix((total[at + length] - total[at]) * inv[at])
                idx = pa.array(np.repeat(np.arange(len(cells)), per))
                start = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx),
                                                  pa.array(start), pa.array(h.view(np.int64))],
                                                 names=["h", "rh", "s", "w"])

    win = stored(reg.select("h", "rh", "bytes").mapInArrow(run, "h long, rh long, s long, w long"), "windows")
    again = stored(win.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w"), "again")
    single = reg.filter("n = 1").select("h", "rh")
    return (win.join(again, "w").groupBy("h", "rh").agg(F.min("s").alias("lo"), (F.max("s") + length).alias("hi"))
            .join(single, ["h", "rh"]))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(k1, k2, spans): for each different text with repeats (k1, k2: hashes
    of the text as in ``_keyed``) its repeated byte spans, merged and sorted."""
    src = _keyed(docs, id_col, text_col)
    multi = stored(_anchored(src.filter(F.octet_length("text") >= length), length)
                   .groupBy("h").agg(F.sum("times").alias("t")).filter("t > 1").select("h"), "multi")
    found = _anchored(src.filter(F.octet_length("text") >= length), length).join(multi, "h")
    found = stored(found.groupBy("h", "rh", "k1", "k2", "a", "b", "size", "off")
                   .agg(F.sum("times").alias("t"), F.min("id").alias("id")), "regions")
    each = stored(found.groupBy("h", "rh").agg(F.sum("t").alias("n"), F.min(F.struct(
        "id", "k1", "k2", "a", "size", "off")).alias("rep")), "each")
    bucket = (each.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least"))
              .filter("k > 1 and least = 1").select("h", "k"))
    wanted = (each.join(bucket, "h").groupBy("rep.id", "rep.k1", "rep.k2")
              .agg(F.collect_list(F.struct("h", "rh", "n", "k", "rep.a", "rep.size", "rep.off")).alias("list")))
    w = wanted.select(F.col("id").alias("wid"), F.col("k1").alias("w1"), F.col("k2").alias("w2"), "list")
    texts = (src.join(w, F.col("id").eqNullSafe(F.col("wid")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
             .select(F.col("text").cast("binary").alias("data"), F.explode("list").alias("x")))
    reg = stored(texts.select("x.h", "x.rh", "x.n", "x.k", "x.off",
                              F.expr("substring(data, cast(x.a as int) + 1, cast(x.size as int))").alias("bytes")), "bytes")
    small = _in_buckets(reg.filter(F.col("k") <= BUCKET).withColumn("off", F.col("off").cast("int")), length)
    large = _by_windows(reg.filter(F.col("k") > BUCKET), length)
    part = (each.filter("n = 1").select("h", "rh", "rep").join(small.unionByName(large), ["h", "rh"])
            .select("rep.k1", "rep.k2", (F.col("rep.a") + F.col("lo")).alias("a"), (F.col("rep.a") + F.col("hi")).alias("b")))
    whole = found.join(each.filter("n > 1").select("h", "rh"), ["h", "rh"]).select("k1", "k2", "a", "b")
    return (whole.unionByName(part).distinct().groupBy("k1", "k2")
            .agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (repeated byte
    spans, merged: array of start, end) and ``kept`` (the other bytes).

    A null text is empty. Texts shorter than ``length`` bytes keep all bytes.
    Repeated rows are repeats of each other and lose all bytes from
    ``length`` on upwards, like other copies; null ids are ids like others. An
    empty table gives an empty result. Matches never cross documents; all
    strings are judged on the input. Other columns are not read.
    """
    found = repeated_spans(docs, id_col, text_col, length)
    src = _keyed(docs, id_col, text_col).join(found, ["k1", "k2"], "left")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                            T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType())])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(1))
            for i, j in K.slices(offs):
                cells, size, spans, kept = b.column(2).slice(i, j - i), np.diff(offs[i:j + 1]), [], []
                for r, cell in enumerate(cells):
                    data = buf[offs[i + r]:offs[i + r + 1]]
                    mine: list[list[int]] = []
                    for s in (cell.as_py() or ()):
                        if mine and s["a"] <= mine[-1][1]:
                            mine[-1][1] = max(mine[-1][1], s["b"])
                        else:
                            mine.append([s["a"], s["b"]])
                    spans.append([{"start": x, "end": y} for x, y in mine])
                    cuts = [0, *(v for m in mine for v in m), len(data)]
                    kept.append(b"".join(data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size), pa.array(spans, span),
                                                  pa.array(kept, pa.binary())], names=schema.names)

    return src.select("id", "text", "spans").mapInArrow(run, schema)
