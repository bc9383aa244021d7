"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (a shorter item
is one window). Containment of a whole window needs all of its words, so its
necessary prefix, with words ordered from rare to common in the documents, is
its single rarest word. The steps:

1. count the benchmark's words in the documents;
2. index each window under its rarest word, with the word's place in it;
3. in each document, look only at the occurrences of those prefix words. The
   place of the word gives the candidate's start; candidates that would begin
   before or end after the document's words are dropped (length and positional
   bounds);
4. compare the candidate's words one by one with the window's.

The benchmark goes through in blocks of about ``BLOCK_BYTES`` of text, each of
which is what the tasks receive; documents are read whole, once for the counts
and once for the matching of each block. Nothing of the documents is shuffled
but the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import of_text

BLOCK_BYTES = 16 << 20

_HITS, _ITEMS, _WORDS = "__hits", "__items", "__words"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[str], list[str]]]:
    """The benchmark's (item ids as text, texts), block by block."""
    b = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.collect()
        if rows:
            yield ["" if r["item"] is None else r["item"] for r in rows], [r["text"] or "" for r in rows]


def _windows(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each window, padded; its length; its item's index)."""
    buf, offs = K.utf8(pa.array(texts, pa.string()))
    h, rows, _, _ = K.words(buf, offs, K.ALNUM)
    count = np.bincount(rows, minlength=len(texts))
    at = np.append(0, np.cumsum(count))[:-1]
    per = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
    start = K.take_ranges(at, per)
    item = np.repeat(np.arange(len(texts)), per)
    size = np.minimum(count[item], window)
    col = np.arange(window)[None, :]
    if not len(start):
        return np.zeros((0, window), np.uint64), size, item
    w = h[np.minimum(start[:, None] + col, len(h) - 1)]
    w[col >= size[:, None]] = 0
    return w, size, item


def _frequencies(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """Documents that hold each word of the (sorted) vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = sent.value
        total = np.zeros(len(voc), np.int64)
        for b in batches:
            buf, offs = K.utf8(b.column(0))
            for i, j in K.slices(offs):
                h, rows, _, _ = K.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], K.ALNUM)
                at = np.minimum(np.searchsorted(voc, h), len(voc) - 1)
                ok = voc[at] == h
                pair = np.unique(rows[ok] * len(voc) + at[ok])
                total += np.bincount(pair % len(voc), minlength=len(voc))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = (docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "k long, n long")
            .groupBy("k").agg(F.sum("n").alias("n")).collect())  # at most one row per benchmark word
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


class _Index:
    """Windows under their rarest word."""

    def __init__(self, w: np.ndarray, size: np.ndarray, item: np.ndarray, voc: np.ndarray, freq: np.ndarray):
        if not len(w):
            self.w, self.size, self.item, self.place = w, size, item, np.zeros(0, np.int64)
            self.key, self.at, self.n = np.zeros(0, np.uint64), self.place, self.place
            return
        f = freq[np.minimum(np.searchsorted(voc, w), len(voc) - 1)]
        f[np.arange(w.shape[1])[None, :] >= size[:, None]] = np.iinfo(np.int64).max
        self.place = np.argmin(f, axis=1)
        can = f[np.arange(len(w)), self.place] > 0  # a word in no document: the window occurs nowhere
        w, size, item, self.place = w[can], size[can], item[can], self.place[can]
        prefix = w[np.arange(len(w)), self.place]
        order = np.argsort(prefix, kind="stable")
        self.w, self.size, self.item, self.place = w[order], size[order], item[order], self.place[order]
        self.key, self.at, self.n = np.unique(prefix[order], return_index=True, return_counts=True)

    def occurrences(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of each occurrence; ``rows`` is sorted."""
        none = np.zeros(0, np.int64)
        if not len(self.key) or not len(h):
            return none, none
        k = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        pos = np.flatnonzero(self.key[k] == h)
        k = k[pos]
        win = K.take_ranges(self.at[k], self.n[k])
        word = np.repeat(pos, self.n[k])
        start = word - self.place[win]
        last = start + self.size[win] - 1
        ok = (start >= 0) & (last < len(h))
        win, start, last, word = win[ok], start[ok], last[ok], word[ok]
        ok = (rows[start] == rows[word]) & (rows[last] == rows[word])
        win, start = win[ok], start[ok]
        for c in range(self.w.shape[1]):
            if not len(win):
                break
            short = c >= self.size[win]
            same = h[np.minimum(start + c, len(h) - 1)] == self.w[win, c]
            ok = short | same
            win, start = win[ok], start[ok]
        return win, start


def _index(docs: DataFrame, text_col: str, texts: list[str], window: int) -> _Index:
    w, size, item = _windows(texts, window)
    voc = np.unique(w[np.arange(window)[None, :] < size[:, None]])
    return _Index(w, size, item, voc, _frequencies(docs, text_col, voc) if len(voc) else voc.astype(np.int64))


def _merge(old: list[int] | None, start: np.ndarray, end: np.ndarray) -> list[int]:
    """Union of word intervals as sorted, disjoint pairs, flattened."""
    if old:
        o = np.array(old).reshape(-1, 2)
        start, end = np.append(start, o[:, 0]), np.append(end, o[:, 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > end[:-1])
    last = np.append(first[1:], True)
    return np.column_stack([start[first], end[last]]).reshape(-1).tolist()


_FOUND = T.StructType([T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
                       T.StructField("words", T.LongType())])


def _matches(text: Column, spark: SparkSession, index: _Index, items: list[str]) -> Column:
    """(hits, items, words) of a text: its hit word intervals, flattened, the
    items with occurring windows, and its number of words."""
    sent = spark.sparkContext.broadcast((index, items))

    def rows(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        index, items = sent.value
        h, rows, _, _ = K.words(buf, offs, K.ALNUM)
        n = np.bincount(rows, minlength=len(offs) - 1)
        hits, found = [None] * len(n), [None] * len(n)
        base = np.cumsum(n) - n
        win, start = index.occurrences(h, rows)
        at = rows[start]
        order = np.argsort(at, kind="stable")
        win, start, at = win[order], start[order], at[order]
        for part in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
            if len(part):
                r = int(at[part[0]])
                s = start[part] - base[r]
                hits[r] = _merge(None, s, s + index.size[win[part]])
                found[r] = sorted({items[x] for x in np.unique(index.item[win[part]])})
        return [pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())), pa.array(n.astype(np.int64))]

    return of_text(text, rows, _FOUND)


def _spans(pairs: Column) -> Column:
    """Flattened intervals as an array of (start, end)."""
    return F.transform(F.filter(pairs, lambda x, i: i % 2 == 0),
                       lambda x, i: F.struct(x.alias("start"), F.get(pairs, 2 * i + 1).alias("end")))


def _united(a: Column, b: Column) -> Column:
    """Union of two lists of flattened intervals, each sorted and disjoint."""
    def add(acc, x):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), longer).otherwise(F.concat(acc, F.array(x)))

    every = F.array_sort(F.concat(_spans(a), _spans(b)))
    merged = F.aggregate(every, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)
    return F.flatten(F.transform(merged, lambda s: F.array(s["start"], s["end"])))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 13, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all) with ``n_words``,
    ``n_hit`` (words inside any occurrence of a window), ``hits`` (their word
    intervals, end exclusive), ``items`` (ids of the items with occurring
    windows, as text, sorted), ``n_items`` and ``contaminated`` (n_hit > 0 and
    20 * n_hit >= n_words).

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z lower-cased. A null text has no words; items without words have no
    window; an item with a null id is listed under the empty text; items with
    equal ids count once. Repeated rows give repeated results; an empty table
    gives an empty result, an empty benchmark finds nothing. Kept columns with
    the name of a new one are replaced.
    """
    new = {"n_words", "n_hit", "hits", "items", "n_items", "contaminated"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    text = F.col(f"`{text_col}`")
    none = F.struct(F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"),
                    F.lit(0).cast("bigint").alias("words"))
    blocks = [(_index(docs, text_col, texts, window), items) for items, texts in _blocks(benchmark, item_col, item_text_col)]
    blocks = blocks or [(_index(docs, text_col, [], window), [])]
    state = docs.select(*[F.col(f"`{c}`") for c in keep],
                        *[_matches(text, docs.sparkSession, i, items).alias(f"__m{k}") for k, (i, items) in enumerate(blocks)])
    got = [F.coalesce(F.col(f"__m{k}"), none) for k in range(len(blocks))]
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    hits, items = empty(got[0]["hits"], "array<bigint>"), empty(got[0]["items"], "array<string>")
    for g in got[1:]:
        hits = _united(hits, empty(g["hits"], "array<bigint>"))
        items = F.array_sort(F.array_union(items, empty(g["items"], "array<string>")))
    state = state.select(*[F.col(f"`{c}`") for c in keep], hits.alias(_HITS), items.alias(_ITEMS), got[0]["words"].alias(_WORDS))
    spans = _spans(F.col(_HITS))
    return (state.withColumn("hits", spans)
            .withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
            .select(*[F.col(f"`{c}`") for c in keep], F.col(_WORDS).alias("n_words"), "n_hit", "hits",
                    F.coalesce(F.col(_ITEMS), F.array().cast("array<string>")).alias("items"))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
