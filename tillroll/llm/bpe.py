"""BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces at safe boundaries, pieces into pre-tokens. All new
pre-tokens of a block are laid out in one symbol array. An index maps each
active merge rank (that is, each mergeable pair) to all positions where the
pair occurs in the block. Ranks are taken in ascending order from a heap; one
step merges all occurrences of a pair at once and updates the lists of the
pairs to its left and right. Merged pieces are remembered within the task, so
a block only merges what it has not seen. Memory is bounded by the block and
by ``CACHE_PIECES``.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

BLOCK_BYTES = 8 << 20
CACHE_PIECES = 1_000_000

#: Fixed value: the pattern that splits text before the merges.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 letters stand for themselves, the rest count up from
    U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file (``.json``)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without prefix space is needed")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        added = spec.get("added_tokens") or []
        if len(added) > 1:
            raise ValueError("at most one special token is supported")
        self.special = (added[0]["content"].encode(), added[0]["id"]) if added else (None, -1)
        letters = byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int32)
        size = max([*vocab.values(), *(a["id"] for a in added)]) + 1
        self.width = size
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        back = {x: i for i, x in enumerate(letters)}
        text = [b""] * size
        for x, i in vocab.items():
            if all(c in back for c in x):
                text[i] = bytes(back[c] for c in x)
        for a in added:
            text[a["id"]] = a["content"].encode()
        self.token_bytes = text
        self.token_len = np.array([len(x) for x in text], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_buf = np.frombuffer(b"".join(text), np.uint8)
        self.split = regex.compile(PRE_TOKEN).findall

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        k = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], -1)

    def merge_all(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, concatenated, and their number for each."""
        size = np.array([len(t) for t in tokens], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(sym)
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), size)
        if n == 0:
            return sym, size
        last = np.append(owner[1:] != owner[:-1], True)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[last] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[np.append(True, last[:-1])] = -1
        rank = np.full(n, -1, np.int32)
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(pos: np.ndarray) -> None:
            """Rank the pairs that begin at pos and enter them in the index."""
            r = np.full(len(pos), -1, np.int32)
            right = nxt[pos]
            has = np.flatnonzero(right >= 0)
            r[has] = self.ranks(sym[pos[has]], sym[right[has]])
            rank[pos] = r
            ok = r >= 0
            if not ok.any():
                return
            pos, r = pos[ok], r[ok]
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            for k, part in zip(r[at].tolist(), np.split(pos, at[1:])):
                if k not in index:
                    heapq.heappush(heap, k)
                index[k].append(part)

        enter(np.arange(n, dtype=np.int32))
        while heap:
            k = heapq.heappop(heap)
            lists = index.pop(k)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            pos = pos[live[pos] & (rank[pos] == k)]
            if not len(pos):
                continue
            pos = np.unique(pos)
            if sym[pos[0]] == sym[nxt[pos[0]]]:  # aaa: leftmost first, no overlap
                follows = np.append(False, nxt[pos[:-1]] == pos[1:])
                start = np.flatnonzero(~follows)
                run = np.arange(len(pos)) - np.repeat(start, np.diff(np.append(start, len(pos))))
                pos = pos[run % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.merged[k]
            live[gone] = False
            rank[gone] = -1
            nxt[pos] = after
            prv[after[after >= 0]] = pos[after >= 0]
            before = prv[pos]
            enter(np.unique(np.concatenate([pos, before[before >= 0]])))
        return sym[live], np.bincount(owner[live], minlength=len(tokens))


class Encoder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        code: dict[str, int] = {}
        split, special = self.v.split, self.v.special[0]
        seq, count = [], []
        for x in texts:
            found = [special] if x == special else split(x.decode("utf-8"))
            count.append(len(found))
            seq.extend([code.setdefault(t, len(code)) for t in found])
        tokens = [b"" if t is special else t.encode() for t in code]
        ids, n = self.v.merge_all(tokens)
        if special in code:  # its own token, never merged from bytes
            k = code[special]
            ids = np.insert(ids, int(n[:k].sum()), self.v.special[1])
            n[k] = 1
        at = np.cumsum(n) - n
        seq = np.array(seq, np.int64)
        ids = ids[K.take_ranges(at[seq], n[seq])]
        ends = np.cumsum(count)
        per = np.append(0, np.cumsum(n[seq]))
        size = per[ends] - per[ends - count]
        begin = np.cumsum(size) - size + len(self.flat)
        self.flat = np.append(self.flat, ids)
        keys = np.append(self.keys, keys)
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], np.append(self.at, begin)[order], np.append(self.n, size)[order]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row ranges with their ids and id offsets."""
        found, keys = [], []
        for i, j in K.slices(offs):
            h, rows, starts, ends = K.pieces(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], self.v.special[0])
            u, first = np.unique(h, return_index=True)
            found.append((i, j, h, rows))
            keys.append((u, starts[first] + offs[i], ends[first] + offs[i]))
        if not found:
            return
        u, first = np.unique(np.concatenate([k[0] for k in keys]), return_index=True)
        starts, ends = (np.concatenate([k[c] for k in keys])[first] for c in (1, 2))
        if len(self.keys) + len(u) > CACHE_PIECES:
            self._reset()
        at = np.searchsorted(self.keys, u)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == u[known]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(u[new], [buf[a:b].tobytes() for a, b in zip(starts[new], ends[new])])
        for i, j, h, rows in found:
            at = np.searchsorted(self.keys, h)
            n = self.n[at]
            ids = self.flat[K.take_ranges(self.at[at], n)]
            per_row = np.bincount(rows, n, j - i).astype(np.int64)
            yield i, j, ids, np.append(0, np.cumsum(per_row))

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows' ids and their offsets."""
        n = self.v.token_len[ids]
        ends = np.append(0, np.cumsum(n))
        return self.v.token_buf[K.take_ranges(self.v.token_at[ids], n)], ends[offs]


def decode_text(data: bytes) -> str:
    """Decoded text; bytes that are no UTF-8 become U+FFFD."""
    return data.decode("utf-8", errors="replace")


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None,
               ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all but the text) with
    ``n_tokens`` (long) and, as asked, ``ids`` (array<int>), ``decoded``
    (string), and as ``digests`` ``ids_sha256`` and ``decoded_sha256`` of the
    ids (little-endian unsigned 32 bit) and of the decoded text.

    A null text is empty: no ids, an empty decoded text. Repeated rows give
    repeated results; an empty table gives an empty one. Kept columns with the
    name of a new one are replaced. Texts of any length are encoded whole.
    """
    import hashlib

    new = {"n_tokens": T.LongType()}
    if ids:
        new |= {"ids": T.ArrayType(T.IntegerType())}
    if decoded:
        new |= {"decoded": T.StringType()}
    if digests:
        new |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c not in new]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text_col))
    schema = T.StructType([*src.drop(text_col).schema.fields, *[T.StructField(k, t) for k, t in new.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or Encoder(vocabulary)
            buf, offs = K.utf8(b.column(len(keep)))
            for p, q in K.slices(offs, BLOCK_BYTES):
                for i, j, tok, at in enc.encode(buf[offs[p]:offs[q]], offs[p:q + 1] - offs[p]):
                    text, text_at = enc.decode(tok, at)
                    cols = [b.column(k).slice(p + i, j - i) for k in range(len(keep))]
                    cols.append(pa.array(np.diff(at)))
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tok, pa.int32())))
                    if decoded:
                        cols.append(pa.array([decode_text(text[x:y].tobytes()) for x, y in zip(text_at, text_at[1:])]))
                    if digests:
                        raw = tok.astype("<u4")
                        cols.append(pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at, at[1:])]))
                        cols.append(pa.array([hashlib.sha256(decode_text(text[x:y].tobytes()).encode()).hexdigest()
                                              for x, y in zip(text_at, text_at[1:])]))
                    yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return src.mapInArrow(run, schema)
