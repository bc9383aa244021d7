"""Language-model scores from an Elias-Fano n-gram trie.

Counting and scoring go by *groups*: a group is about ``GROUP_BYTES`` of
documents, chosen by a hash of the row.

1. Documents travel as compressed blocks of their group. Each group lists its
   distinct words as sorted 64-bit hashes and its longer n-grams, apart from
   them, as shorter ones, with their counts in its training documents, and
   sends each hash range (*shard*) of a list to the shard's task, as gaps of a
   few bytes each, cut from one array. An n-gram is one entry per group,
   however often it occurs.
2. A shard adds the counts up and answers every group with the totals of its
   entries, in their order.
3. Each group scores its texts slice by slice, about ``SLICE`` tokens at once,
   with the tokens before a slice as context. A slice builds its part of the
   model, the n-grams that its tokens can ask for: levels of a trie whose
   pointers and successors are monotone Elias-Fano sequences, with quantised
   log probabilities and back-off weights. The levels are written to a file
   that only this task reads, and memory-mapped. Tokens are scored by
   context-relative successor search in them.

The numbers of groups and of shards follow the size of the texts, and so does
the length of the hashes, so that an entry's chance to share its hash stays
what it is.

So the model's size follows the corpus while no task, and never the driver,
holds more of it than one group or one shard.

Probabilities: P(w) = (c + 0.1) / (N + 0.1 (V + 1)), and per order
P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), with m = ``PRIOR``.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import elias_fano as ef
from . import kernels as K
from .common import crc_mod

GROUP_BYTES = 6 << 20
SHARD_BYTES = 6 << 20
SLICE = 300_000
KEY_BYTES = 5  # that an n-gram's offset in its shard takes
PRIOR = 2.0
WORD_BITS = 64
STEP = 1 / 4000  # of the quantised log10 probabilities
_END = K.mix(np.array([0xE0D], np.uint64))[0]


def tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row of each): words and one end per row."""
    buf, offs = K.utf8(text)
    hs, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in K.slices(offs):
        h, r, _, _ = K.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], K.NON_SPACE)
        hs.append(h)
        rows.append(r + i)
    n = len(offs) - 1
    h = np.concatenate([*hs, np.full(n, _END)])
    r = np.concatenate([*rows, np.arange(n)])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def gram_bits(shards: int) -> int:
    """Bits of the hashes of longer n-grams: a shard's offsets fit in
    ``KEY_BYTES``."""
    return min(WORD_BITS, 8 * KEY_BYTES + shards.bit_length() - 1)


def grams(h: np.ndarray, rows: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each order: hashes of its n-grams and the place of each's last token."""
    out = []
    for k in range(1, order + 1):
        at = np.flatnonzero(rows[k - 1:] == rows[:len(rows) - k + 1])
        out.append((K.chain_hash(h, k)[at] >> np.uint64(64 - (WORD_BITS if k == 1 else bits)), at + k - 1))
    return out


def _longer(gs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in gs[1:]]])


def _pack(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(docs)
    return sink.getvalue().to_pybytes()


def _unpack(blocks: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in blocks])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ...) -> (part, block): the rows of each group, compressed."""
    for b in batches:
        part = b.column(0).to_numpy()
        order = np.argsort(part, kind="stable")
        docs = pa.Table.from_batches([b]).drop_columns(["part"])
        cells, parts = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(rows):
                parts.append(int(part[rows[0]]))
                cells.append(_pack(docs.take(pa.array(rows))))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], names=["part", "block"])


def _cells(data: np.ndarray, cut: np.ndarray, width: int) -> pa.Array:
    """Binary cells of consecutive fields, cut at the given field numbers."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _counts_out(c: np.ndarray, cut: np.ndarray) -> list[pa.Array]:
    """Counts as bytes, and apart those that are larger than a byte tells."""
    big = np.flatnonzero(c > 254)
    return [_cells(np.minimum(c, 255).astype(np.uint8), cut, 1), _cells(c[big].astype("<i8"), np.searchsorted(big, cut), 8)]


def _counts_in(small: list, big: list) -> np.ndarray:
    c = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.uint8) for x in small]])
    c[c == 255] = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<i8") for x in big]])
    return c


def _shard_starts(shards: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // shards for k in range(shards)], np.uint64)


def _keys_out(off: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Cells of rising numbers, cut at the given places: a byte that says how
    many bytes the cell's gaps take, then its gaps."""
    n = np.diff(cut)
    gap = np.diff(off, prepend=np.uint64(0))
    some = np.flatnonzero(n)
    gap[cut[some]] = off[cut[some]]  # a cell's first gap is its first number
    width = np.zeros(len(n), np.int64)
    if len(some):
        most = np.maximum.reduceat(gap, cut[some])
        width[some] = 1 + sum((most >= np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
    at = np.append(0, np.cumsum(1 + n * width))
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1]] = width
    cell = np.repeat(np.arange(len(n)), n)
    wide = width[cell]
    to = at[cell] + 1 + (np.arange(len(off)) - cut[cell]) * wide
    for k in range(int(width.max(initial=0))):
        has = slice(None) if (wide > k).all() else np.flatnonzero(wide > k)
        out[to[has] + k] = (gap[has] >> np.uint64(8 * k)).astype(np.uint8)
    return _cells(out, at, 1)


def _keys_in(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    width = int(raw[0]) if len(raw) else 0
    if not width:
        return np.zeros(0, np.uint64)
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(-1, width)
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


_MESSAGE = "part int, shard int, keys binary, counts binary, large binary"
_REPLY = "part int, shard int, counts binary, large binary"


def _messages(part: int, uniq: np.ndarray, counts: np.ndarray, shards: int, words: bool) -> list[pa.Array]:
    """A group's message to each shard that holds some of its entries."""
    starts = _shard_starts(shards, WORD_BITS if words else gram_bits(shards))
    first = shards if words else 0  # shards from there on hold words
    cut = np.append(np.searchsorted(uniq, starts), len(uniq))
    off = uniq - np.repeat(starts, np.diff(cut))
    some = pa.array(np.flatnonzero(np.diff(cut)))
    return [pa.array(np.full(len(some), part, np.int32)), pa.array(some.to_numpy().astype(np.int32) + first),
            _keys_out(off, cut).take(some), *[x.take(some) for x in _counts_out(counts, cut)]]


def _entries(h: np.ndarray, rows: np.ndarray, order: int, shards: int):
    """A group's n-grams, its distinct longer ones and words, both sorted, and
    each n-gram's entry (int32): the words' come after the longer ones'."""
    gs = grams(h, rows, order, gram_bits(shards))
    uniq, inv = np.unique(_longer(gs), return_inverse=True)
    words, word = np.unique(gs[0][0], return_inverse=True)
    return [at for _, at in gs], uniq, words, np.concatenate([word.astype(np.int32) + np.int32(len(uniq)), inv.astype(np.int32)])


def _ask(part: int, docs: pa.Table, order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A group's messages: of its longer n-grams, then of its words."""
    h, rows = tokens(docs.column("text"))
    learn = ~np.asarray(docs.column("held_out").to_numpy(), bool)[rows]
    ends, uniq, words, inv = _entries(h, rows, order, shards)
    counts = np.bincount(inv[np.concatenate([learn[at] for at in ends])], minlength=len(uniq) + len(words))
    for u, c, w in ((uniq, counts[:len(uniq)], False), (words, counts[len(uniq):], True)):
        yield pa.RecordBatch.from_arrays(_messages(part, u, c, shards, w), names=[x.split()[0] for x in _MESSAGE.split(", ")])


def _answer(table: pa.Table) -> pa.Table:
    """The totals of each group's entries."""
    keys = [_keys_in(x) for x in table.column("keys").to_pylist()]
    own = _counts_in(table.column("counts").to_pylist(), table.column("large").to_pylist())
    cut = np.append(0, np.cumsum([len(x) for x in keys]))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    sums = np.add.reduceat(own[order], first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    return pa.Table.from_arrays([table.column("part"), table.column("shard"), *_counts_out(total, cut)],
                                names=["part", "shard", "counts", "large"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of training rows; a task adds up about ``SLICE`` words
    before it sends them."""
    def added(parts):
        w, n = (np.concatenate(x) for x in zip(*parts))
        u, inv = np.unique(w, return_inverse=True)
        return u, np.bincount(inv, n, len(u)).astype(np.int64)

    def batch(w, n):
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for b in batches:
        h, _ = tokens(b.column(0))
        held = added([held, np.unique(h, return_counts=True)])
        if len(held[0]) > 4 * SLICE:
            yield batch(*held)
            held = held[0][:0], held[1][:0]
    yield batch(*held)


def _quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Levels on disk. ``levels[k]`` of order k + 2 holds pointers (start of
    each context's successors), successors, probabilities and weights."""

    def __init__(self, folder: str, arrays: dict[str, np.ndarray]):
        path, self.a, at = os.path.join(folder, "trie"), {}, 0
        with open(path, "wb") as f:
            for x in arrays.values():
                f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))
        data = np.asarray(np.memmap(path, np.uint8, "r"))
        for name, x in arrays.items():
            self.a[name] = data[at:at + x.nbytes].view(x.dtype)
            at += x.nbytes + -x.nbytes % 8

    @staticmethod
    def level(name: str, context: np.ndarray, word: np.ndarray, contexts: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Arrays of a level and the entries' order in it."""
        order = np.lexsort((word, context))
        context, word = context[order], word[order].astype(np.uint64)
        ptr = np.searchsorted(context, np.arange(contexts + 1))
        # successors count on from the last one of the context before
        last = np.flatnonzero(np.append(context[1:] != context[:-1], True)) if len(context) else np.zeros(0, np.int64)
        gain = np.zeros(contexts, np.uint64)
        gain[context[last]] = word[last] + np.uint64(1)
        base = np.append(np.uint64(0), np.cumsum(gain)[:-1]) if contexts else np.zeros(0, np.uint64)
        seq = base[context] + word + np.uint64(1)
        out = {f"{name}.ptr.{k}": v for k, v in ef.build(ptr, len(context)).items()}
        top = int(seq[-1]) + 1 if len(seq) else 1
        out |= {f"{name}.seq.{k}": v for k, v in ef.build(seq, top).items()} | {f"{name}.top": np.array([top])}
        return out, order

    def _seq(self, name: str) -> dict[str, np.ndarray]:
        return {k: self.a[f"{name}.{k}"] for k in ("n", "low", "upper", "ones", "zeros")}

    def find(self, name: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of the entry (context, word) in a level, -1 without one."""
        out = np.full(len(context), -1, np.int64)
        ptr, seq = self._seq(f"{name}.ptr"), self._seq(f"{name}.seq")
        if not int(seq["n"][0]):
            return out
        top = int(self.a[f"{name}.top"][0])
        start = ef.values(ptr).astype(np.int64)  # of every context's successors
        last = ef.get(seq, np.maximum(start[:-1] - 1, 0))
        last[start[:-1] == 0] = 0
        for i in range(0, len(context), 1 << 17):
            c, w = context[i:i + (1 << 17)], word[i:i + (1 << 17)].astype(np.uint64)
            lo, hi, base = start[c], start[c + 1], last[c]
            ok = np.flatnonzero(lo < hi)
            x = np.minimum(base[ok] + w[ok] + np.uint64(1), np.uint64(top))
            at, same = ef.successor(seq, x)
            same &= (at < hi[ok]) & (x == base[ok] + w[ok] + np.uint64(1))  # in this context
            out[i + ok[same]] = at[same]
        return out


def _slice_scores(entry: list[np.ndarray], total: np.ndarray, order: int, n: int, v: int) -> np.ndarray:
    """log10 probability of each token of a slice. ``entry[k]`` holds, for each
    token, the number of the (k + 1)-gram that ends there, or -1; ``total``
    the count of each number."""
    m, size = len(total), len(entry[0])
    ends = [np.flatnonzero(x >= 0) for x in entry]
    p1_of = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    # of each order: its distinct n-grams (entry, last token of one
    # occurrence), and the number among them of the n-gram that ends at a token
    which, place = [], []
    at_token, number, mark = np.empty(m, np.int32), np.empty(m, np.int32), np.zeros(m, bool)
    for k in range(order):
        own = entry[k][ends[k]]
        at_token[own] = ends[k]
        mark[own] = True
        u = np.flatnonzero(mark)
        mark[u] = False
        number[u] = np.arange(len(u), dtype=np.int32)
        x = np.full(size, -1, np.int32)
        x[ends[k]] = number[own]
        which.append((u, at_token[u]))
        place.append(x)
    del at_token, number, mark
    arrays: dict[str, np.ndarray] = {}
    counts = [total[u] for u, _ in which]
    known = np.flatnonzero(counts[0] > 0)
    ids = np.full(len(counts[0]), -1, np.int64)
    ids[known] = np.arange(len(known))  # word ids; also the places in the first level
    prob = [10.0 ** p1_of(counts[0])]
    arrays["1.p"] = _quantised(np.log10(prob[0])[known])
    arrays["1.b"] = _quantised(np.log10(PRIOR / (counts[0][known] + PRIOR)))
    spot = [ids]  # place of each distinct n-gram in its level
    for k in range(1, order):
        at = which[k][1]
        live = np.flatnonzero(counts[k] > 0)
        t = at[live]
        ctx, low = place[k - 1][t - 1], place[k - 1][t]
        p = np.zeros(len(at))
        p[live] = (counts[k][live] + PRIOR * prob[k - 1][low]) / (counts[k - 1][ctx] + PRIOR)
        level, perm = Trie.level(str(k + 1), spot[k - 1][ctx], ids[place[0][t]], int((spot[k - 1] >= 0).sum()))
        arrays |= level
        arrays[f"{k + 1}.p"] = _quantised(np.log10(p[live][perm]))
        arrays[f"{k + 1}.b"] = _quantised(np.log10(PRIOR / (counts[k][live][perm] + PRIOR)))
        where = np.full(len(at), -1, np.int64)
        where[live[perm]] = np.arange(len(live))
        spot.append(where)
        prob.append(p)
    unknown = float(p1_of(0))
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(folder, arrays)
        take = lambda name, at: -STEP * trie.a[name][np.maximum(at, 0)] if len(trie.a[name]) else np.zeros(len(at))
        score = np.where(ids >= 0, take("1.p", ids), unknown)
        found = [ids]
        for k in range(1, order):
            t = which[k][1]
            ctx = found[k - 1][place[k - 1][t - 1]]
            word = ids[place[0][t]]
            hit = np.full(len(t), -1, np.int64)
            ok = np.flatnonzero((ctx >= 0) & (word >= 0))
            hit[ok] = trie.find(str(k + 1), ctx[ok], word[ok])
            less = score[place[k - 1][t]] + np.where(ctx >= 0, take(f"{k}.b", ctx), 0.0)
            score = np.where(hit >= 0, take(f"{k + 1}.p", hit), less)
            found.append(hit)
            if k == 1:
                per_token = np.where(ids >= 0, take("1.p", ids), unknown)[place[0]]
            per_token[ends[k]] = score[place[k][ends[k]]]
        if order == 1:
            per_token = score[place[0]]
        del trie
    return per_token


def _score(blocks: pa.Table, back: pa.Table, order: int, shards: int, n: int, v: int, schema: pa.Schema) -> pa.Table:
    docs = _unpack(blocks.column("block"))
    h, rows = tokens(docs.column("text"))
    ends, uniq, words, inv = _entries(h, rows, order, shards)
    m = len(uniq) + len(words)
    del uniq, words
    back = back.sort_by("shard")  # the order in which the entries were sent
    total = _counts_in(back.column("counts").to_pylist(), back.column("large").to_pylist())
    if len(total) != m:
        raise ValueError("a group's totals do not fit its n-grams")
    entry, at = [], 0
    for end in ends:
        x = np.full(len(h), -1, np.int32)
        x[end] = inv[at:at + len(end)]
        entry.append(x)
        at += len(end)
    del h, inv
    c = total[entry[0]]
    log10 = np.empty(len(rows))
    for i in range(0, len(rows), SLICE):
        j = min(i + SLICE, len(rows))
        a = max(0, i - order + 1)  # context only
        part = [x[a:j].copy() for x in entry]
        for k in range(1, order):
            part[k][:k] = -1  # begins before the slice
        log10[i:j] = _slice_scores(part, total, order, n, v)[i - a:]
    size = docs.num_rows
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    return pa.Table.from_arrays([
        docs.column("id").combine_chunks(), docs.column("held_out").combine_chunks(),
        pa.array(np.bincount(rows, minlength=size)), pa.array(np.bincount(rows, c > 0, size).astype(np.int64)),
        pa.array(np.full(size, n, np.int64)), pa.array(np.bincount(rows, base, size)), pa.array(np.bincount(rows, log10, size)),
    ], schema=schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, folds: int = 10,
              held_out_fold: int = 0) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (unigram log10 probability)
    and ``score`` (the model's log10 probability of the text).

    Tokens are words between white space, A-Z lower-cased, and one end. The
    model learns from the rows whose crc32 of the id as text, mod ``folds``,
    is not ``held_out_fold``; rows with a null id are learned from. A null text
    is empty (its one token is the end). Repeated rows all count and score
    alike; equal texts score alike. Without training rows N and V are 0 and
    all tokens unknown. An empty table gives an empty result. Other columns
    are not read.
    """
    held = F.coalesce(crc_mod(id_col, folds) == held_out_fold, F.lit(False))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                      held.alias("held_out"))
    size = src.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    groups, shards = size // GROUP_BYTES + 1, size // SHARD_BYTES + 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")
    blocks = src.select(part.alias("part"), "id", "text", "held_out").mapInArrow(_in_blocks, "part int, block binary")

    words = (src.filter("not held_out").select("text").mapInArrow(_word_counts, "word long, n long")
             .groupBy("word").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.count("*")).first())
    n, v = int(words[0] or 0), int(words[1] or 0)

    asked = blocks.groupBy("part").applyInArrow(
        lambda t: pa.Table.from_batches(_ask(t.column("part")[0].as_py(), _unpack(t.column("block")), order, shards)), _MESSAGE)
    back = asked.groupBy("shard").applyInArrow(_answer, _REPLY)
    schema = T.StructType([T.StructField(id_col, src.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return (blocks.groupBy("part").cogroup(back.groupBy("part"))
            .applyInArrow(lambda x, y: _score(x, y, order, shards, n, v, arrow), schema))
