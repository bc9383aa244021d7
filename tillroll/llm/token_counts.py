"""Token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is cut into byte-balanced blocks. Inside a block the texts are
split at safe boundaries (before a space that follows a visible character, and
around special tokens), where no pre-token of a byte-level vocabulary can run
across. The distinct pieces are encoded in byte-balanced batches and only their
lengths are kept; a text's count is the sum over its pieces. Memory is bounded
by the block, whatever the length of one text; texts are never cut short.

Vocabularies that do not split this way (``.model`` files, or a ``.json`` with
a normaliser or another pre-tokeniser) are encoded whole text by whole text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BLOCK_BYTES = 16 << 20   # texts whose pieces are counted together
BATCH_BYTES = 256 << 10  # bytes handed to one encode_batch call
CACHE_PIECES = 2_000_000  # remembered piece lengths per task (16 bytes each)


def _encoder(path: str) -> tuple[Callable[[list[str]], np.ndarray], bytes | None, bool]:
    """(texts -> lengths, special token, may split at spaces)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda xs: np.array([len(x) for x in sp.encode(xs, num_threads=1)], np.int64), None, False
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    split = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(added) <= 1
             and not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")))
    special = added[0]["content"].encode() if split and added else None

    def lengths(xs: list[str]) -> np.ndarray:
        return np.array([len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)], np.int64)

    return lengths, special, split


def _batched(texts: Iterator[bytes], lengths) -> np.ndarray:
    out, batch, size = [np.zeros(0, np.int64)], [], 0
    for x in texts:
        batch.append(x.decode("utf-8"))
        size += len(x)
        if size >= BATCH_BYTES:
            out.append(lengths(batch))
            batch, size = [], 0
    if batch:
        out.append(lengths(batch))
    return np.concatenate(out)


class _Counter:
    def __init__(self, path: str):
        self.lengths, self.special, self.split = _encoder(path)
        self.keys, self.vals = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def count(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row of one block."""
        if not self.split:
            return _batched((buf[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])), self.lengths)
        parts, where = [], []
        for i, j in K.slices(offs):
            h, rows, starts, ends = K.pieces(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], self.special)
            parts.append((h, rows + i))
            where.append((starts + offs[i], ends + offs[i]))
        if not parts:
            return np.zeros(len(offs) - 1, np.int64)
        h = np.concatenate([p[0] for p in parts])
        starts, ends = (np.concatenate([w[k] for w in where]) for k in (0, 1))
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        n = np.zeros(len(uniq), np.int64)
        n[known] = self.vals[at[known]]
        new = np.flatnonzero(~known)
        n[new] = _batched((buf[a:b].tobytes() for a, b in zip(starts[first[new]], ends[first[new]])), self.lengths)
        if len(self.keys) + len(new) > CACHE_PIECES:
            self.keys, self.vals = uniq, n.astype(np.int32)
        else:
            keys, vals = np.append(self.keys, uniq[new]), np.append(self.vals, n[new].astype(np.int32))
            order = np.argsort(keys)
            self.keys, self.vals = keys[order], vals[order]
        rows = np.concatenate([p[1] for p in parts])
        return np.bincount(rows, n[inv], len(offs) - 1).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens",
                 keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default all but the text) with
    ``n_bytes`` and ``out_col`` (long) added.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give
    repeated results; an empty table gives an empty one. Kept columns called
    ``n_bytes`` or ``out_col`` are replaced. ``vocabulary`` is a path that
    exists on every executor (an installed file).
    """
    new = {"n_bytes", out_col}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c not in new]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text_col))
    fields = [*src.drop(text_col).schema.fields]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or _Counter(vocabulary)
            buf, offs = K.utf8(b.column(len(keep)))
            n = [np.zeros(0, np.int64)]
            for i, j in K.slices(offs, BLOCK_BYTES):
                n.append(counter.count(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]))
            cols = [b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offs)), pa.array(np.concatenate(n))],
                                             names=[*keep, "n_bytes", out_col])

    return src.mapInArrow(run, schema)
