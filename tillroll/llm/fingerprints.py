"""Document fingerprints from spot signatures.

Anchors are common words (a fixed list for English, French, German and
Spanish). Each anchor and the chain of the next ``CHAIN`` content words form a
spot signature. Words outside these chains (lists, code, other languages) begin
plain word runs. A document's fingerprint is its set of signature hashes, so
every stretch of a text is in it before and after an edit.
Fingerprints are compared by Jaccard similarity. ``similar_pairs`` finds all
pairs that reach an asked likeness: sets meet on their rarest signatures, and
only between length partitions close enough to reach it.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import stored

CHAIN = 2
HOT = 1000  # sets that list a signature, from which on they are salted

#: Common words of four languages.
COMMON = """
the a an and or but of to in on at by for with from as is are was were be been
it its this that these those he she they we you not no has have had will would
le la les un une des du de et ou en dans par pour avec sur que qui ne pas est
sont il elle ils elles au aux ce cette ces se son sa ses
der die das den dem ein eine einen einem und oder in im von zu zur mit auf für
nicht ist sind war er sie es ich wir als auch bei aus nach dass sich
el los las una unos unas y o del al con por para no es son su sus lo se más
""".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    size = [len(w.encode()) for w in words]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    return np.unique(K.words(buf, np.append(0, np.cumsum(size)), K.ALNUM)[0])


ANCHORS = _word_hashes(COMMON)


def _rest(h: np.ndarray, rows: np.ndarray, spot: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the word runs for what the chains from ``spot`` to
    ``last`` leave out: of ``CHAIN`` + 1 words from each word outside them, or
    up to the row's end near it. Shorter rows: the whole sequence."""
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, spot, 1)
    np.add.at(step, last + 1, -1)
    out = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    cut = np.searchsorted(rows, np.arange(n + 1))
    begin, end = cut[rows[out]], cut[rows[out] + 1]
    at = np.maximum(np.minimum(out, end - CHAIN - 1), begin)
    size = np.minimum(end - begin, CHAIN + 1)
    value = np.zeros(len(out), np.uint64)
    for k in range(1, CHAIN + 2):
        value[size == k] = K.chain_hash(h, k)[at[size == k]]
    return rows[out], value


def signatures(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each row.

    Words outside all complete anchored chains begin runs of ``CHAIN`` + 1
    words (fewer in the row: the whole sequence), so every word is in a
    signature, and which ones depends on the words around it only. A row
    without words, but not empty, has the hash of its bytes; an empty row has
    none.
    """
    n = len(offs) - 1
    h, rows, _, _ = K.words(buf, offs, K.ALNUM)
    at = np.minimum(np.searchsorted(ANCHORS, h), len(ANCHORS) - 1)
    anchor = ANCHORS[at] == h
    spot = np.flatnonzero(anchor)
    content = np.flatnonzero(~anchor)
    k = np.searchsorted(content, spot)
    spot, k = spot[k + CHAIN <= len(content)], k[k + CHAIN <= len(content)]
    ok = rows[content[k + CHAIN - 1]] == rows[spot]
    spot, k = spot[ok], k[ok]
    sig = h[spot]
    for c in range(CHAIN):
        sig = K.mix(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[k + c]])
    rest_rows, rest = _rest(h, rows, spot, content[k + CHAIN - 1], n)
    sig = np.concatenate([sig, rest]) >> np.uint64(32)
    sig = np.unique((np.concatenate([rows[spot], rest_rows]).astype(np.uint64) << np.uint64(32)) | sig)
    cut = np.searchsorted(sig, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    sig = sig.astype(np.uint32)
    out = []
    for i in range(n):
        s = sig[cut[i]:cut[i + 1]]
        if not len(s) and offs[i + 1] > offs[i]:
            digest = hashlib.sha256(buf[offs[i]:offs[i + 1]].tobytes()).digest()
            s = np.frombuffer(digest[:4], np.uint32)
        out.append(s)
    return out


def written(s: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits per signature, ascending."""
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 where the lengths alone rule ``least`` out. Two
    empty sets are alike (1)."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by the beginning of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _rows(texts: list[str], following: list[str], least: float) -> list[pa.Array]:
    """Result columns of texts, each with the text that follows it."""
    changed = [edited(x, y) for x, y in zip(texts, following)]
    own, new, after = (signatures(*K.utf8(pa.array(c, pa.large_string()))) for c in (texts, changed, following))
    return [pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
            pa.array([written(s) for s in own], pa.string()), pa.array([written(s) for s in new], pa.string()),
            pa.array([likeness(a, b, least) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b, least) for a, b in zip(own, after)], pa.float64())]


def _schema(id_type: T.DataType) -> T.StructType:
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    return T.StructType([T.StructField("id", id_type), *[T.StructField(c, k) for c, k in zip(_RESULT, kinds)]])


def _key(ident, h: int) -> tuple:
    """Sorts as descending ids, nulls last, then ascending hashes do (ids of
    one type compare among themselves only)."""
    return (ident is None, _Descending(ident), h)


class _Descending:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return self.value is not None and other.value is not None and other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def _splits(src: DataFrame, order: list) -> list[tuple]:
    """(id, hash) of the first row of each part of the order: four per shuffle
    partition."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.slice(0, 1)
                break
        for _ in batches:  # read to the end
            pass

    # a stated number of parts: small as the ids are, they are not merged
    parts = 4 * int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = src.select("id", "h").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = keys.mapInArrow(first, keys.schema).distinct().collect()
    return sorted(((r["id"], r["h"]) for r in rows), key=lambda r: _key(*r))


def _range_of(splits: list[tuple]):
    """(ids, hashes) -> range numbers; range k begins at the k-th split."""
    keys = [_key(*s) for s in splits]
    return lambda ids, hs: [max(0, bisect.bisect_right(keys, _key(i, h)) - 1) for i, h in zip(ids, hs)]


def _with_range(src: DataFrame, splits: list[tuple]) -> DataFrame:
    schema = T.StructType([*src.schema.fields, T.StructField("range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _range_of(splits)
        for b in batches:
            k = place(b.column(0).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32())], names=schema.names)

    return src.mapInArrow(run, schema)


def _first_rows(src: DataFrame, splits: list[tuple]) -> DataFrame:
    """The foremost row of each range: every task finds its own, the few
    that are left meet by range."""
    schema = T.StructType([*src.schema.fields, T.StructField("range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, best = _range_of(splits), {}
        for b in batches:
            ids, hs = b.column(0).to_pylist(), b.column(2).to_pylist()
            for row, (i, h, k) in enumerate(zip(ids, hs, place(ids, hs))):
                if k not in best or _key(i, h) < best[k][0]:
                    best[k] = (_key(i, h), b.slice(row, 1))
            best = {k: (key, pa.RecordBatch.from_pylist(r.to_pylist(), r.schema)) for k, (key, r) in best.items()}
        for k, (_, r) in best.items():
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array([k], pa.int32())], names=schema.names)

    top = Window.partitionBy("range").orderBy(F.col("id").desc_nulls_last(), "h")
    return (src.mapInArrow(run, schema).withColumn("n", F.row_number().over(top)).filter("n = 1").drop("n"))


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           least: float = 0.0) -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint`` and ``edited_fingerprint``, ``near_edited`` (likeness of
    the text and its edited form), ``near_next`` (of the text and the next
    one).

    Documents are ordered by descending id, null ids last, equal ids by a hash
    of the text; the next of the last is the first. The edited form has the
    last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document. A null text is empty and has the empty fingerprint.
    A repeated row is its twin's next document. An empty table gives an empty
    result; other columns are not read.

    Texts travel once: split points of the order (one id and hash per
    partition) cut it into ranges, and each range also gets a copy of the
    row that follows its last one.
    """
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    order = [F.col("id").desc_nulls_last(), F.col("h").asc()]
    splits = _splits(src, order)
    done = _schema(id_type)
    if not splits:
        return docs.sparkSession.createDataFrame([], done).withColumnRenamed("id", id_col)
    ranged = _with_range(src, splits)
    # the first row of each range, held as the last one of the range before
    first = stored(_first_rows(src, splits), "first")
    parts = [r[0] for r in first.select("range").orderBy("range").collect()]  # ranges that have rows
    before = docs.sparkSession.createDataFrame(list(zip(parts, parts[-1:] + parts[:-1])), "range int, before int")
    after = first.join(before, "range").select("id", "text", "h", F.col("before").alias("range"), F.lit(1).alias("extra"))
    rows = (ranged.withColumn("extra", F.lit(0)).unionByName(after).repartition("range")
            .sortWithinPartitions("range", "extra", *order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: (id as an array, text, range)
        for b in batches:
            size = np.diff(K.utf8(b.column(1))[1])
            for i, j in K.slices(np.append(0, np.cumsum(size))):
                ids, texts = b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).to_pylist()
                where, extra = (b.column(k).slice(i, j - i).to_pylist() for k in (2, 3))
                if held:
                    ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                    where, extra = [held[2], *where], [0, *extra]
                n = len(texts) - 1
                use = [k for k in range(n) if not extra[k]]
                if use:
                    cols = _rows([texts[k] for k in use], [texts[k + 1] for k in use], least)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(use)), *cols], names=done.names)
                held = None if extra[n] else (ids.slice(n, 1), texts[n], where[n])

    return (rows.select("id", "text", "range", "extra").mapInArrow(run, done)
            .withColumnRenamed("id", id_col))


def _sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(fp, sigs) of the distinct non-empty fingerprints."""
    schema = T.StructType([T.StructField("fp", T.StringType()), T.StructField("sigs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(0))
            for i, j in K.slices(offs):
                some = [x for x in signatures(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in some], pa.string()),
                     pa.array([x.astype(np.int64) for x in some], pa.list_(pa.int64()))], names=schema.names)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(text.alias("t")).mapInArrow(run, schema).dropDuplicates(["fp"])


def similar_pairs(docs: DataFrame, least: float, text_col: str = "text") -> DataFrame:
    """All pairs of different fingerprints in ``docs`` whose Jaccard similarity
    is ``least`` (over 0, at most 1) or more: ``a`` < ``b`` and ``likeness``.

    A fingerprint is named by the SHA-256 of its written form, as
    ``sha2(fingerprint, 256)`` of ``fingerprint_neighbours`` gives it; texts
    of equal fingerprints are one set, so copies are compared once. Empty
    fingerprints are in no pair.

    Signatures are ordered from rare to common over the sets. Two sets that
    are alike share one in their prefixes of size - ceil(least * size) + 1,
    and their length partitions (powers of 1 / ``least``) are the same or
    adjacent. Lengths and places rule pairs out before the sets are compared.
    Sets that list a common signature are salted, those that probe repeated.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    sets = stored(_sets(docs, text_col).withColumn("size", F.size("sigs").cast("long")), "sets")
    each = sets.select("fp", "size", F.explode("sigs").alias("sig"))
    held = each.groupBy("sig").agg(F.count("*").alias("n"))
    rare = each.join(held, "sig").groupBy("fp", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("sigs"))
    prefix = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    # a little wider than 1 / least: rounding puts no pair two partitions apart
    width = -math.log(least * (1 - 1e-9))
    entries = stored(rare.select("fp", "size", F.posexplode(F.slice("sigs", 1, prefix)).alias("at", "s"))
                     .select("fp", "size", "at", "s.sig", F.floor(F.log("size") / width).alias("part"),
                             (F.floor(F.col("s.n") / HOT) + 1).alias("salts")), "entries")
    listed = entries.select("part", "sig", F.expr("pmod(xxhash64(fp), salts)").alias("salt"),
                            F.col("fp").alias("x"), F.col("size").alias("nx"), F.col("at").alias("ax"))
    probes = entries.select(F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("part").alias("own"), "sig",
                            "salts", F.col("fp").alias("y"), F.col("size").alias("ny"), F.col("at").alias("ay"))
    probes = probes.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    most = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))  # shared from here on
    near = (F.least("nx", "ny") >= F.greatest("nx", "ny") * least - 1e-6) & (
        most * (1 + least) >= (F.col("nx") + F.col("ny")) * least - 1e-6)
    once = (F.col("own") > F.col("part")) | (F.col("x") < F.col("y"))
    found = (listed.join(probes, ["part", "sig", "salt"]).filter(once & near)
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("sigs").alias(f"s{c}"))
    same = F.size(F.array_intersect("sa", "sb"))
    return (found.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", (same / (F.size("sa") + F.size("sb") - same)).alias("likeness"))
            .filter(F.col("likeness") >= least))
