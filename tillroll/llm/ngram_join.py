"""Jaccard join of shingle sets, filtered by several global token orders.

A global order ranks all shingles of the corpus. If two sets reach the asked
similarity, their prefixes under that order (the first n - ceil(t n) + 1 of n
shingles) share a shingle, whatever the order is. So a candidate pair must
share a prefix shingle under each of ``ORDERS`` orders. All orders put common
shingles last and differ among shingles of one frequency class.

1. One scan counts shingles in a table of ``CELLS`` cells, of fixed size. A
   shingle's class tells how far its cell lies above the mean.
2. A second scan writes each document's set size, a signature of its set (the
   class of documents with equal sets), the prefixes of the further orders,
   and the set as a compact list: as many leading bits of each hash as tell
   its shingles apart, in one byte or so each.
3. A third scan sends the first order's prefix shingles to their buckets, each
   class once per task. Buckets with one class go; of several with the same
   classes one stays.
4. A bucket is not expanded into pairs: round one pairs its classes with one
   leader of their length partition. Round two takes the larger buckets that
   still hold several components and pairs their classes with a few leaders
   of other components, so that groups of near copies grow together by a
   number of pairs in proportion to their size. Round three compares, block by
   block, what then lies outside a bucket's largest component with all classes
   of near lengths.
5. Pairs pass the length bound, the bound from the places of the shared
   shingle, a bound from parity bits of both sets, the prefixes of the further
   orders and a bound from the compact lists, which can only overrate an
   intersection. What is left is verified on full sets. Round three asks the
   first three before a pair is written down, and the places as those of the
   first shingle that a pair shares: a linked pair passes in that bucket.

Whether two texts inside a component are linked is not asked when links of
others connect them: the result has the components of all links.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import discard, near_filter, stored
from .components import components
from .minhash import shingle_sets

ORDERS = 3
CELL_BITS = 22
CELLS = 1 << CELL_BITS
CHUNK = 1 << 14  # cells that are merged together
BLOCK = 512  # members of one bucket that are compared at once
LEADERS = 24  # of a bucket and length partition in round two
WORDS = 8  # 64-bit words of parity bits of a set
PARITY = [f"w{k}" for k in range(WORDS)]
SENT = 200_000  # nodes that a task remembers to have sent
_SALTS = [np.uint64(x) for x in np.random.default_rng(12).integers(1, 1 << 63, ORDERS)]


def _sets(docs: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, shingles, offsets) of slices of (id, text) batches."""
    for b in docs:
        buf, offs = K.utf8(b.column(1))
        for i, j in K.slices(offs):
            yield (b.column(0).slice(i, j - i), *shingle_sets(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], width))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequency_classes(src: DataFrame, width: int) -> np.ndarray:
    """Class of each cell (uint8, 0: near or under the mean) from the shingle
    counts of all documents. Tasks send their counts packed; one task adds up
    a chunk of cells; the driver gets ``CELLS`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for _, s, _ in _sets(batches, width):
            n += np.bincount(_cell(s), minlength=CELLS)
        for k in range(0, CELLS, CHUNK):
            at = np.flatnonzero(n[k:k + CHUNK])
            if len(at):
                packed = np.diff(at, prepend=0).astype(np.uint16).tobytes() + n[k + at].astype(np.uint64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(packed, 1)], pa.binary())],
                                                 names=["k", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1)):
                raw = zlib.decompress(packed.as_buffer())
                m = len(raw) // 10
                at = np.cumsum(np.frombuffer(raw, np.uint16, m).astype(np.int64))
                total.setdefault(k, np.zeros(CHUNK, np.int64))[at] += np.frombuffer(raw, np.uint64, m, 2 * m).astype(np.int64)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["k", "cells"])

    schema = "k int, cells binary"
    n = np.zeros(CELLS, np.int64)
    for r in src.mapInArrow(count, schema).repartition("k").mapInArrow(add, schema).collect():
        n[r["k"]:r["k"] + CHUNK] = np.frombuffer(r["cells"], np.int64)
    mean = n.mean()
    base = 4 * math.sqrt(mean) + 8  # above what the cells' other shingles make of it
    over = np.maximum(n - mean, 1e-9) / base
    return np.where(over < 1, 0, 1 + np.minimum(np.log2(np.maximum(over, 1)) * 2, 60)).astype(np.uint8)


def prefix_size(n, percent: int):
    """n - ceil(t n) + 1, for n > 0."""
    return n - (percent * n + 99) // 100 + 1


def prefixes(s: np.ndarray, classes: np.ndarray, percent: int, orders: int = ORDERS) -> list[np.ndarray]:
    """The prefix of one set under each order, by that order. An entry ranks
    by class, then by the order's own hash of the shingle."""
    if not len(s):
        return [np.zeros(0, np.uint64)] * orders
    top = classes[_cell(s)].astype(np.uint64) << np.uint64(58)
    p = prefix_size(len(s), percent)
    return [np.sort(np.partition(top | (K.mix(s ^ salt) >> np.uint64(6)), p - 1)[:p]) for salt in _SALTS[:orders]]


def compact(s: np.ndarray) -> bytes:
    """A sorted set as gaps of its leading bits: five more bits than its size
    has. A gap is written to the base 255, with 255 for each full one."""
    if not len(s):
        return b""
    gap = np.diff(s >> np.uint64(64 - _level(len(s))), prepend=np.uint64(0)).astype(np.int64)
    out = np.full(int((gap // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


def _level(n: int) -> int:
    return n.bit_length() + 5


def _flat(cells: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The binary cells one after the other as numbers, and their lengths."""
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    _, ob, db = cells.buffers()
    offs = np.frombuffer(ob, np.int32, len(cells) + 1, cells.offset * 4).astype(np.int64)
    data = np.frombuffer(db, np.uint8)[offs[0]:offs[-1]] if db else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offs) // np.dtype(kind).itemsize


def expanded(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The compact lists of the cells, one after the other, and the cell of
    each value."""
    b, size = _flat(cells, np.uint8)
    total = np.append(0, np.cumsum(b, dtype=np.int64))
    cell = np.repeat(np.arange(len(size)), size)
    ends = np.flatnonzero(b != 255)
    base = total[np.cumsum(size) - size]
    return total[ends + 1] - base[cell[ends]], cell[ends]


def _numbered(key: np.ndarray) -> np.ndarray:
    """Sorted keys, equal ones told apart by their number."""
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return (key << 8) + np.minimum(nth, 255)


def most_common(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of compact lists x and y: upper bounds of the intersections'
    sizes, from the shingles that agree in the bits that both lists have, and
    the sizes of both sets."""
    (vx, rx), (vy, ry) = expanded(x), expanded(y)
    nx, ny = np.bincount(rx, minlength=len(x)), np.bincount(ry, minlength=len(y))
    lx, ly = (np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 6 for n in (nx, ny))  # _level
    low = np.minimum(lx, ly)
    kx = _numbered((rx << 40) | (vx >> (lx - low)[rx]))
    ky = _numbered((ry << 40) | (vy >> (ly - low)[ry]))
    at = np.minimum(np.searchsorted(kx, ky), max(len(kx) - 1, 0))
    same = kx[at] == ky if len(kx) else np.zeros(len(ky), bool)
    return np.bincount(ry, same, len(y)).astype(np.int64), nx, ny


def share_all(x: pa.Array, y: pa.Array) -> np.ndarray:
    """For rows of prefixes x and y: whether they share an entry in each
    further order."""
    keys = []
    for cells in (x, y):
        v, size = _flat(cells, np.uint16)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(v)) - (np.cumsum(size) - size)[row]
        order = place * (ORDERS - 1) // np.maximum(size, 1)[row]
        keys.append(((row * (ORDERS - 1) + order) << 16) | v)
    hit = np.intersect1d(*keys) >> 16
    return np.bincount(np.unique(hit) // (ORDERS - 1), minlength=len(x)) == ORDERS - 1


def _node(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set: documents with equal sets are one node."""
    c = np.append(np.uint64(0), np.cumsum(K.mix(s ^ np.uint64(0x51A5))))
    return K.mix(c[at[1:]] - c[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def parity(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, one bit per cell of a small table: whether an odd number
    of its shingles fall there. Two sets differ in at least as many shingles
    as their bits do."""
    m, bits = len(at) - 1, 64 * WORDS
    cell = ((K.mix(s ^ np.uint64(0xB17)) >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(m), np.diff(at)) * bits + cell, minlength=m * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(m, WORDS)


def _documents(src: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, node, q, c, w0..): set size, signature, the prefixes of the
    further orders (16 bits an entry, one order after the other), the compact
    list, the parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, at in _sets(batches, width):
            each = [s[a:b] for a, b in zip(at[:-1], at[1:])]
            q = [np.concatenate(prefixes(x, classes, percent)[1:]).astype(np.uint16).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(at)), pa.array(_node(s, at)), pa.array(q, pa.binary()),
                 pa.array([compact(x) for x in each], pa.binary()), *map(pa.array, parity(s, at).T)], names=schema.names)

    schema = T.StructType([src.schema["id"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("q", T.BinaryType()), T.StructField("c", T.BinaryType()),
                           *[T.StructField(w, T.LongType()) for w in PARITY]])
    return src.mapInArrow(run, schema)


def _entries(src: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(key, node, n, at): the prefix shingles of the first order, of those
    buckets that hold several nodes."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies are sent once, or a few times by a large task
        for _, s, at in _sets(batches, width):
            node, size = _node(s, at), np.diff(at)
            keys, rows = [np.zeros(0, np.uint64)], []
            if len(sent) > SENT:
                sent.clear()
            for i, v in enumerate(node.tolist()):
                if size[i] and v not in sent:
                    sent.add(v)
                    keys.append(prefixes(s[at[i]:at[i + 1]], classes, percent, 1)[0])
                    rows.append(i)
            each = np.array([len(k) for k in keys[1:]], np.int64)
            place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            row = np.repeat(np.array(rows, np.int64), each)
            # signed keys in the global order
            key = (np.concatenate(keys) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]),
                                              pa.array((size[row] << 32) | place)], names=["key", "node", "place"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, those whose key has another node; equal rows once.
        The last row waits for the next batch."""
        last, seen = np.zeros((3, 0), np.int64), False  # a row, and whether it is out already
        for b in batches:
            x = np.concatenate([last, np.stack([b.column(k).to_numpy() for k in range(3)])], axis=1)
            new = np.ones(x.shape[1], bool)
            new[1:] = (x[:2, 1:] != x[:2, :-1]).any(0)
            x = x[:, new]
            same = np.append(False, x[0, 1:] == x[0, :-1])
            out = same | np.append(same[1:], False)
            if last.shape[1] and seen:
                out[0] = False
            if x.shape[1]:
                seen = bool(out[-1]) or (seen and x.shape[1] == 1)
                last = x[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(v[out]) for v in x], names=["key", "node", "place"])

    rows = "key long, node long, place long"
    found = (src.select("id", "text").mapInArrow(send, rows).repartition("key").sortWithinPartitions("key", "node")
             .mapInArrow(several, rows))
    return found.select("key", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("at"))


def _different_buckets(entries: DataFrame) -> DataFrame:
    """Of buckets with the same nodes that which comes first in the global
    order: a pair that meets in several is compared there. The first bucket in
    which a pair meets always stays."""
    nodes = entries.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    return entries.join(nodes.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _bounded(nx, ny, ax, ay, percent: int, least=np.minimum, most=np.maximum):
    """Whether sets of sizes nx and ny that share the shingles at places ax
    and ay of a global order may reach the similarity: what lies before both
    places, or behind both, is all that they can share besides."""
    shared = least(ax, ay) + 1 + least(nx - ax - 1, ny - ay - 1)
    return (100 * least(nx, ny) >= percent * most(nx, ny)) & ((100 + percent) * shared >= percent * (nx + ny))


def _bounded_first(nx, ny, ax, ay, percent: int):
    """The same if it is the first shingle in the order that the sets share:
    they share nothing before it."""
    shared = 1 + np.minimum(nx - ax - 1, ny - ay - 1)
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((100 + percent) * shared >= percent * (nx + ny))


def _near_bits(nx, ny, differ, percent: int):
    """Whether sets of sizes nx and ny whose parity bits differ in so many
    places may reach the similarity."""
    return (100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny)


def _leader_pairs(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the leader of its bucket and length partition,
    if places and parity bits leave the similarity possible."""
    head = entries.groupBy("key", "lc").agg(F.min(F.struct("node", "n", "at")).alias("m"))
    near = _bounded(F.col("m.n"), F.col("n"), F.col("m.at"), F.col("at"), percent, F.least, F.greatest)
    pairs = (entries.join(head, ["key", "lc"]).filter((F.col("node") != F.col("m.node")) & near)
             .select(F.col("m.node").alias("a"), F.col("node").alias("b")).distinct())
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"),
                                       *[F.col(w).alias(side + w) for w in PARITY]), side)
    differ = sum((F.bit_count(F.col("a" + w).bitwiseXOR(F.col("b" + w))) for w in PARITY[1:]),
                 F.bit_count(F.col("aw0").bitwiseXOR(F.col("bw0"))))
    return pairs.filter(_near_bits(F.col("na"), F.col("nb"), differ, percent)).select("a", "b")


def _mixed_members(entries: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: c is a member's
    component, main the bucket's largest one, k the number of members in the
    bucket's length partition."""
    member = entries.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = (member.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key")
             .agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("cs"))
             .filter("cs > 1").select("key", F.col("m.c").alias("main")))
    sizes = member.groupBy("key", "lc").agg(F.count("*").alias("k"))
    return member.join(mixed, "key").join(sizes, ["key", "lc"]).join(sets.select("node", *PARITY), "node")


def _stray_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket and length partition with its
    ``LEADERS`` members of least salted hashes, if they are of different
    components. Partitions of few members are left to round three."""
    large = rows.filter(F.col("k") > 2 * LEADERS)
    lead = large.groupBy("key", "lc").agg(F.array(*[
        F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "c", "n", "at", *PARITY)) for salt in range(LEADERS)]).alias("m"))
    both = large.join(lead.select("key", "lc", F.explode("m").alias("m")), ["key", "lc"])
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"m.{w}"))) for w in PARITY), F.lit(0))
    near = (_bounded(F.col("m.n"), F.col("n"), F.col("m.at"), F.col("at"), percent, F.least, F.greatest)
            & _near_bits(F.col("m.n"), F.col("n"), differ, percent))
    return (both.filter((F.col("c") != F.col("m.c")) & near)
            .select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct())


def _between_components(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and pass its
    bounds and that of their parity bits."""
    rows = rows.withColumn("blocks", F.ceil(F.col("k") / BLOCK)).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sizes = rows.select("key", "lc", "blocks").distinct()
    packed = F.collect_list(F.struct("node", "c", "n", "at", *PARITY))
    every = rows.groupBy("key", "lc", "blk").agg(packed.alias("y"))
    strays = (rows.filter("c <> main").groupBy("key", F.col("lc").alias("own"), "blk").agg(packed.alias("x")).drop("blk")
              .withColumn("lc", F.explode(F.expr("array(own - 1, own, own + 1)")))
              .join(sizes, ["key", "lc"]).withColumn("blk", F.explode(F.expr("sequence(0L, blocks - 1)"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "c", "n", "at", *PARITY)
        columns = lambda cell: (cell.values.field(c).to_numpy(zero_copy_only=False) for c in names)
        for b in batches:
            found = [np.zeros((0, 2), np.int64)]
            for x, y in zip(b.column(0), b.column(1)):
                (ix, cx, nx, ax, *wx), (iy, cy, ny, ay, *wy) = columns(x), columns(y)
                i, j = np.nonzero((cx[:, None] != cy) & _bounded_first(nx[:, None], ny, ax[:, None], ay, percent))
                differ = np.zeros(len(i), np.int64)
                for u, v in zip(wx, wy):
                    differ += np.bitwise_count((u[i] ^ v[j]).view(np.uint64))
                near = _near_bits(nx[i], ny[j], differ, percent)
                i, j = i[near], j[near]
                found.append(np.stack([np.minimum(ix[i], iy[j]), np.maximum(ix[i], iy[j])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return strays.join(every, ["key", "lc", "blk"]).select("x", "y").mapInArrow(run, "a long, b long").distinct()


def _in_all_orders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a prefix shingle under each further order, and
    whose compact lists leave the similarity possible."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("q").alias(f"q{side}"), F.col("c").alias(f"c{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                part = part.filter(pa.array(share_all(part.column(2), part.column(3))))
                same, nx, ny = most_common(part.column(4), part.column(5))
                yield part.select(["a", "b"]).filter(pa.array((100 + percent) * same >= percent * (nx + ny)))

    return pairs.select("a", "b", "qa", "qb", "ca", "cb").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, src: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, written;
    ``classes`` has the id (rep) of one document of each node."""
    pairs = likely = stored(pairs, "pairs")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node")
    need = stored(need.select(F.col("rep").alias("id")).distinct(), "need")
    texts = near_filter(src, need, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, at in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(_node(s, at)), pa.array([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                                             names=["node", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same) and same > 0)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # a row that repeats an id and its text gives its set once
    sets = stored(texts.mapInArrow(read, "node long, s binary").dropDuplicates(["node"]), "sets")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}")), side)
    out = stored(pairs.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct(), "verified")
    discard(likely, need, sets)
    return out


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                     percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (set size) and
    ``component_id`` (the smallest id reachable over links, its own included).

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their sets of ``width``-word shingles; with fewer words the whole sequence
    is the one shingle. Words are lower-cased (A-Z). Every filter is a bound
    that no linked pair misses, and links are confirmed on full sets, so the
    result is exact (shingles and sets are known by 64-bit hashes).

    Null or word-less texts have 0 shingles and are linked with nothing. Rows
    with a null id are linked with nothing and have a null component. Rows
    that repeat an id count as one document with several texts. An empty table
    gives an empty result. Other columns are not read.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known_ids = src.filter("id is not null")
    ranks = frequency_classes(src, width)
    s = stored(_documents(src, ranks, width, percent), "documents")
    live = s.filter("n > 0 and id is not null")
    classes = stored(live.groupBy("node").agg(F.min("id").alias("rep")), "classes")
    # a little wider than 1 / t: rounding puts no pair two partitions apart
    part = -math.log(percent / 100 * (1 - 1e-9)) if percent < 100 else 1e-9
    shared = stored(_entries(known_ids, ranks, width, percent).withColumn("lc", F.floor(F.log("n") / part)), "shared")
    entries = stored(_different_buckets(shared), "entries")
    sets = stored(live.join(entries.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
                  .select("node", "n", "q", "c", *PARITY), "compact")
    discard(shared)
    # an id that has several texts ties their nodes together
    several = live.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("id", "a")
    tied = live.join(several, "id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = _in_all_orders(_leader_pairs(entries, sets, percent), sets, percent)
    links = stored(_verified(first, classes, known_ids, width, percent).union(tied), "links")
    comp = components(links).select("node", "component")
    more = _in_all_orders(_stray_pairs(_mixed_members(entries, comp, sets), percent), sets, percent)
    links = links.union(_verified(more, classes, known_ids, width, percent))
    comp = stored(components(links).select("node", "component"), "comp")
    rest = _in_all_orders(_between_components(_mixed_members(entries, comp, sets), percent), sets, percent)
    rest = _verified(rest, classes, known_ids, width, percent)
    comp = stored(components(links.union(rest)).select("node", "component"), "comp")
    discard(entries, sets)
    named = classes.join(comp, "node", "left").withColumn("group", F.coalesce("component", "node"))
    lowest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "group").select("node", "component_id")
    out = s.select("id", "n", "node").join(named, "node", "left")
    linked = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked.alias("component_id"))
