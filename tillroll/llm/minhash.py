"""Near-duplicate detection with HyperMinHash registers.

1. A document's shingle hashes fall into ``BUCKETS`` buckets. A bucket keeps
   its smallest value as an 8-bit register: the count of leading zeros and
   four mantissa bits.
2. Documents with equal shingle sets (exact copies) become one class.
3. The registers of each class are banded. Empty buckets first borrow from
   filled ones, each in its own fixed random order, so that short documents
   band like long ones.
4. A bucket of the band table is not expanded into pairs. Round one compares
   its members with its smallest id only. Round two takes the buckets that
   still hold several components, and holds each member outside the bucket's
   largest component against all members of other components, in blocks of
   registers; only pairs that may reach the similarity leave a block. So a
   group of thousands of near copies costs about one row per member, and every
   pair that shares a bucket ends in one component or has been compared.
5. Candidates pass a length bound, a bound on differing registers, and the
   collision-corrected Jaccard estimate with a margin; what is left is confirmed on
   full shingle sets.
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
from .components import components

BUCKETS = 512
BANDS = 64
MANTISSA = 4
BLOCK = 256  # members of one bucket whose registers are compared at once
MARGIN = 5.0  # standard deviations that the estimate may lie under the similarity
#: Fixed value: chance of equal registers without a shared minimum, times 2**mantissa bits.
COLLISION = 0.169919487159739

_rng = np.random.default_rng(512)
# PROBE[j] is the order in which an empty bucket j tries the others
PROBE = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.int32)
PROBE_RANK = np.argsort(PROBE, axis=1).astype(np.int32)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, concatenated, and offsets.
    A row with fewer words than ``width`` has its whole sequence as its one
    shingle; a row without words has none."""
    h, rows, _, _ = K.words(buf, offs, K.NON_SPACE)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    at = np.append(0, np.cumsum(count))
    full = K.chain_hash(h, width)
    out, size = [], np.zeros(n, np.int64)
    short = {}
    for k in range(1, width):
        idx = np.flatnonzero(count == k)
        if len(idx):
            short.update(zip(idx.tolist(), K.chain_hash(h, k)[at[idx]]))
    for i in range(n):
        if count[i] >= width:
            s = np.unique(full[at[i]:at[i + 1] - width + 1])
        elif count[i]:
            s = np.array([short[i]], np.uint64)
        else:
            continue
        out.append(s)
        size[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(size))


def registers(shingles: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) uint8; 0 marks an empty bucket."""
    n = len(offs) - 1
    none = np.iinfo(np.uint64).max
    low = np.full(n * BUCKETS, none, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offs))
    np.minimum.at(low, row * BUCKETS + (shingles & np.uint64(BUCKETS - 1)).astype(np.int64), shingles >> np.uint64(12))
    mant, exp = np.frexp(low.astype(np.float64))  # 52-bit values: exact
    zeros = np.clip(52 - exp, 0, 14)
    reg = 1 + (zeros << MANTISSA) + np.clip((mant - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    reg[low == none] = 0
    return reg.astype(np.uint8).reshape(n, BUCKETS)


def filled(reg: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets hold the first filled one in their order."""
    out = reg.copy()
    have = (reg > 0).sum(1)
    for i in np.flatnonzero((have > 0) & (have <= 48)):  # few choices: rank them
        src = np.flatnonzero(reg[i])
        out[i] = reg[i, src[np.argmin(PROBE_RANK[:, src], axis=1)]]
        out[i, src] = reg[i, src]
    r, c = np.nonzero((reg == 0) & (have > 48)[:, None])
    k = 0
    while len(r):
        v = reg[r, PROBE[c, k]]
        out[r, c] = v
        r, c = r[v == 0], c[v == 0]
        k += 1
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of the filled registers. A band takes
    registers that lie BANDS apart."""
    per = BUCKETS // BANDS
    g = filled(reg).reshape(len(reg), per, BANDS).transpose(0, 2, 1).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(reg), BANDS)).copy()
    for k in range(per):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + g[:, :, k])
    return key


def may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of registers x and y (set sizes nx, ny) may belong to sets
    with the similarity t = ``percent`` / 100.

    The length bound is exact. So is that on differing buckets: a bucket
    differs only if its smallest shingle is not shared, and at similarity t at
    most (1 - t) (nx + ny) / (1 + t) shingles are not. The estimate is the share
    of equal buckets less that of chance matches. A bucket shows one of its shingles,
    so the estimate's variance is that of drawing without replacement.
    """
    t = percent / 100
    used = ((x > 0) | (y > 0)).sum(-1)
    same = ((x == y) & (x > 0)).sum(-1)
    total = (nx + ny) / (1 + t)  # size of the union at similarity t
    ratio = np.maximum(nx, ny) / np.maximum(1, np.minimum(nx, ny))
    chance = COLLISION * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = np.maximum(0, (same / np.maximum(used, 1) - chance) / (1 - chance))
    spread = np.sqrt(t * (1 - t) / np.maximum(used, 1) * np.clip((total - used) / np.maximum(total - 1, 1), 0, 1))
    return ((used > 0) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
            & (used - same <= (1 - t) * total + 1e-9)
            & (share >= t - MARGIN * spread - chance - 1 / np.maximum(used, 1)))


def _binary_rows(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(flat).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1,
                                 [None, pa.py_buffer((offs * flat.itemsize).astype(np.int32)), pa.py_buffer(data)])


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, sig_a, sig_b, reg) of each document."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(1))
            for i, j in K.slices(offs):
                s, at = shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                reg = registers(s, at)
                n = np.diff(at)
                sig = []
                for salt in (0x51A5, 0xC0FFEE):
                    c = np.append(np.uint64(0), np.cumsum(K.mix(s ^ np.uint64(salt))))
                    sig.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                regs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(
                    (np.arange(j - i + 1) * BUCKETS).astype(np.int32)), pa.py_buffer(reg)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(sig[0]),
                                                  pa.array(sig[1]), regs], names=["id", "n", "sig_a", "sig_b", "reg"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("sig_a", T.LongType()), T.StructField("sig_b", T.LongType()),
                           T.StructField("reg", T.BinaryType())])
    return src.mapInArrow(run, schema)


def _bands(reps: DataFrame) -> DataFrame:
    """(id, key): one row per band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                reg = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BUCKETS)
                key = band_keys(reg).view(np.int64)
                idx = pa.array(np.repeat(np.arange(len(reg)), BANDS))
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), pa.array(key.reshape(-1))], names=["id", "key"])

    schema = T.StructType([reps.schema["id"], T.StructField("key", T.LongType())])
    return reps.select("id", "reg").mapInArrow(run, schema)


def _members(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, reg, s): registers and full sets of the documents in ``ids``;
    rows that repeat an id and its text count once."""
    src = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
           .join(ids.hint("merge"), "id", "left_semi").withColumn("h", F.xxhash64("text"))
           .dropDuplicates(["id", "h"]).select("id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = K.utf8(b.column(1))
            for i, j in K.slices(offs):
                s, at = shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(at)),
                     _binary_rows(registers(s, at).reshape(-1), np.arange(j - i + 1) * BUCKETS), _binary_rows(s, at)],
                    names=["id", "n", "reg", "s"])

    schema = T.StructType([src.schema["id"], T.StructField("n", T.LongType()), T.StructField("reg", T.BinaryType()),
                           T.StructField("s", T.BinaryType())])
    return src.mapInArrow(run, schema)


def _linked(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. The estimate
    goes first, so that few sets travel."""
    for side in "ab":
        pairs = pairs.join(members.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"),
                                          F.col("reg").alias(f"r{side}")).hint("merge"), side)
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in (4, 5))
                ok = may_reach(x, y, part.column(2).to_numpy(), part.column(3).to_numpy(), percent)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same) and same > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(likely, schema).distinct()
    for side in "ab":
        out = out.join(members.select(F.col("id").alias(side), F.col("s").alias(f"s{side}")).hint("merge"), side)
    return out.select("a", "b", "sa", "sb").mapInArrow(compare, schema).distinct()


def _between_components(bands: DataFrame, comp: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may reach
    the similarity."""
    member = stored(bands.join(comp.hint("merge"), bands.id == comp.node, "left")
                    .select("key", "id", F.coalesce("component", "id").alias("c")), "member")
    mixed = (member.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key")
             .agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("cs"), F.sum("k").alias("size"))
             .filter("cs > 1").select("key", F.col("m.c").alias("main"), F.ceil(F.col("size") / BLOCK).alias("blocks")))
    rows = (member.join(mixed, "key").join(members.select("id", "n", "reg").hint("merge"), "id")
            .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    packed = F.collect_list(F.struct("id", "c", "n", "reg"))
    every = rows.groupBy("key", "blk").agg(packed.alias("y"))
    # a block of strays goes to every block of its bucket, so that a large
    # bucket is many keys
    strays = (rows.filter("c <> main").groupBy("key", "blocks", "blk").agg(packed.alias("x")).drop("blk")
              .withColumn("blk", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks"))
    schema = T.StructType([T.StructField("a", member.schema["id"].dataType), T.StructField("b", member.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(cell):
            v = cell.values
            reg = np.frombuffer(b"".join(v.field("reg").to_pylist()), np.uint8).reshape(-1, BUCKETS)
            return v.field("id").to_pylist(), v.field("c").to_pylist(), v.field("n").to_numpy(zero_copy_only=False), reg

        for b in batches:
            found = set()
            for cx, cy in zip(b.column(0), b.column(1)):
                (ix, gx, nx, rx), (iy, gy, ny, ry) = block(cx), block(cy)
                for k in range(len(ix)):
                    ok = np.flatnonzero(may_reach(rx[k][None, :], ry, nx[k], ny, percent))
                    found.update((min(ix[k], iy[m]), max(ix[k], iy[m])) for m in ok.tolist() if gx[k] != gy[m])
            cols = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, b.column(0).type.value_type.field("id").type) for c in cols],
                                             names=["a", "b"])

    return strays.join(every, ["key", "blk"]).select("x", "y").mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the
    smallest id reachable over links, its own included), ``kept`` (the id is
    its component's).

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``width``-word shingles. Banding finds a pair at exactly the
    threshold of 0.8 with probability 1 - (1 - 0.8**8)**64, more than 0.9999;
    what it finds is confirmed on full sets.

    Null or word-less texts have 0 shingles and are linked with nothing. Rows
    with a null id are linked with nothing: component null, kept. Rows that
    repeat an id count as one document with several texts. An empty table
    gives an empty result. Other columns are not read.
    """
    s = stored(sketches(docs, id_col, text_col, width), "sketches")
    live = s.filter("n > 0 and id is not null")
    classes = stored(live.groupBy("sig_a", "sig_b", "n").agg(F.min("id").alias("rep")), "classes")
    reps = stored(live.join(classes, ["sig_a", "sig_b", "n"]).filter("id = rep")
                  .select("id", "n", "reg").dropDuplicates(["id", "n", "reg"]), "reps")
    bands = _bands(reps)
    shared = bands.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    bands = stored(bands.join(shared, "key"), "bands")
    members = stored(_members(docs, bands.select("id").distinct(), id_col, text_col, width), "members")
    lowest = bands.groupBy("key").agg(F.min("id").alias("a"))
    first = bands.join(lowest, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    # an id that has several texts ties their classes together
    known = live.select("id", "sig_a", "sig_b", "n").join(classes, ["sig_a", "sig_b", "n"]).select("id", "rep").distinct()
    several = known.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
    tied = known.join(several, "id").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = stored(_linked(first, members, percent).union(tied), "links")
    rest = stored(_between_components(bands, components(links), members, percent), "rest")
    comp = stored(components(links.union(_linked(rest, members, percent))), "comp")

    out = (s.select("id", "n", "sig_a", "sig_b")
           .join(classes, ["sig_a", "sig_b", "n"], "left")
           .join(comp, F.col("rep") == F.col("node"), "left"))
    linked = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked.alias("component_id"),
                      (F.col("id").isNull() | (linked == F.col("id"))).alias("kept"))
