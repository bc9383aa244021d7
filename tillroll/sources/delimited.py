"""Quoted delimited text in splittable files.

A cell in quotes may hold separators, doubled quotes and line breaks, so a
line is not a record, and a split of a file may begin inside a cell. Files are
still read split by split, never whole by one task:

1. every split is run through the quote automaton from both states it can
   begin in, outside and inside quotes; what comes out is one small row;
2. a window over each file's splits chains these rows: a split begins in the
   last state that an earlier split forces, turned as often as the splits in
   between turn it;
3. every split parses the records that begin and end in it. The open ends of
   records that cross a border are put together by the split they begin in.

Quoting is what spreadsheets write: a quote opens a cell only at the cell's
beginning, two quotes inside stand for one, and a record ends at the line break
outside quotes. Records that do not fit the header are kept apart, with the
file, the split and the line at which they begin.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST_RECORD = 16 << 20  # bytes of one record; a longer one is rejected
QUOTE = b'"'
WHOLE, HEAD, TAIL = 0, 1, 2


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line): the bytes of each line, and where its split of
    which file begins. Lines of a split are in order."""
    return _text(spark, path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))


# --- quoting ---------------------------------------------------------------------------
def open_after(line: bytes, opened: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open after the line, if one was (``opened``)
    or was not before it."""
    i = 0
    while True:
        if not opened:
            if line[i:i + 1] != QUOTE:
                i = line.find(sep + QUOTE, i) + 1
                if not i:
                    return False
            i, opened = i + 1, True
        j = line.find(QUOTE, i)
        if j < 0:
            return True
        if line[j + 1:j + 2] == QUOTE:
            i = j + 2
            continue
        # closed: what follows up to the next separator has no quoting
        i, opened = line.find(sep, j + 1) + 1, False
        if not i:
            return False


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, block), lines) for each stretch of a batch of one split."""
    blocks, files = b.column(1).to_numpy(), b.column(0).dictionary_encode().indices.to_numpy()
    new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])) + 1
    for i, j in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
        if j > i:
            yield (b.column(0)[i].as_py(), int(blocks[i])), b.column(2).slice(i, j - i)


def _quoted(lines: pa.Array) -> list[int]:
    """Numbers of the lines that hold a quote; others leave the state as it is."""
    _, ob, db = lines.buffers()
    offs = np.frombuffer(ob, np.int32, len(lines) + 1, lines.offset * 4)
    if db is None or offs[-1] == offs[0]:
        return []
    at = np.flatnonzero(np.frombuffer(db, np.uint8)[offs[0]:offs[-1]] == QUOTE[0])
    return np.unique(np.searchsorted(offs - offs[0], at, "right") - 1).tolist()


def split_states(lines: DataFrame, sep: bytes) -> DataFrame:
    """(file, block, opened, left): whether each split begins, and whether it
    ends, inside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list[bool]] = {}
        for b in batches:
            for at, some in _stretches(b):
                begins = at[1] == 0 and at not in state
                ends = state.setdefault(at, [False, True])
                for k in _quoted(some):
                    line = some[k].as_py()
                    if begins and k == 0:
                        line = line.removeprefix(codecs.BOM_UTF8)
                    if ends[0] == ends[1]:
                        ends[0] = ends[1] = open_after(line, ends[0], sep)
                    else:
                        ends[:] = [open_after(line, x, sep) for x in ends]
        yield _batch([(*k, *v) for k, v in state.items()], ends_schema)

    ends_schema = _schema("file string, block long, shut boolean, open boolean")
    ends = lines.mapInArrow(run, ends_schema)
    chain = Window.partitionBy("file").orderBy("block")
    before, upto = (chain.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    turns = F.sum((F.col("shut") & ~F.col("open")).cast("int"))
    forced = F.when(F.col("shut") == F.col("open"), F.struct("shut", turns.over(upto).alias("turns")))
    out = ends.withColumn("forced", forced).select(
        "file", "block", "shut", "open", F.coalesce(turns.over(before), F.lit(0)).alias("turns"),
        F.last("forced", ignorenulls=True).over(before).alias("by"))
    turned = F.pmod(F.col("turns") - F.coalesce(F.col("by.turns"), F.lit(0)), F.lit(2)) == 1
    opened = F.coalesce(F.col("by.shut"), F.lit(False)) != turned
    return out.withColumn("opened", opened).select(
        "file", "block", "opened", F.when(F.col("opened"), F.col("open")).otherwise(F.col("shut")).alias("left"))


# --- records ---------------------------------------------------------------------------
def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(cols, schema)],
                                      names=schema.names)


def _longer(have: bytes, line: bytes, longest: int) -> bytes:
    """A record with one more line; it is cut where it is too long anyway."""
    return have + b"\n" + line if len(have) < longest else have


def walk(batches: Iterator[pa.RecordBatch], opened: frozenset, sep: bytes, longest: int
         ) -> Iterator[list[tuple[tuple[str, int], int, int, bytes, bool]]]:
    """Per batch, (split, kind, line, bytes, closed) of the records and parts
    in it. ``WHOLE``: a record that begins and ends in the split. ``HEAD``: the
    rest of a record of an earlier split. ``TAIL``: a record that the split
    leaves open. ``line``: where it begins, from 1; ``closed``: whether the
    record ends here."""
    at, n, inside, kind, have, first = None, 0, False, WHOLE, b"", 0

    def rest():
        """What the last split leaves open."""
        return [(at, kind if kind == HEAD else TAIL, first, have, False)] if at and inside else []

    for b in batches:
        out = []
        for split, some in _stretches(b):
            if split != at:
                out += rest()
                at, n, first, have = split, 0, 1, None
                inside = split in opened
                kind = HEAD if inside else WHOLE
            quoted = set(_quoted(some))
            for k, line in enumerate(some.to_pylist()):
                n += 1
                if n == 1 and split[1] == 0:
                    line = line.removeprefix(codecs.BOM_UTF8)
                if inside:
                    have = line if have is None else _longer(have, line, longest)
                else:
                    have, first = line, n
                if inside or k in quoted:
                    inside = open_after(line, inside, sep)
                if not inside:
                    out.append((at, kind, first, have, True))
                    kind = WHOLE
        yield out
    yield rest()


class _Parser:
    """Cells of records, and the reasons for which some are rejected."""

    def __init__(self, sep: str, encoding: str, header: bool, width: int, longest: int):
        self.sep, self.encoding, self.header, self.width, self.longest = sep, encoding, header, width, longest
        self.schema = _schema("file string, block long, line long, n_cells int, reason string, record string"
                              + "".join(f", c{k} string" for k in range(width)))

    def _cells(self, text: str) -> list[str] | str:
        csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
        try:
            return next(csv.reader([text], delimiter=self.sep), [])
        except csv.Error as e:
            return str(e)

    def rows(self, records: list[tuple[tuple[str, int], int, bytes, bool]]) -> pa.RecordBatch:
        """``records``: (split, line, bytes, closed)."""
        out, none = [], (None,) * self.width
        for split, line, record, closed in records:
            if self.header and split[1] == 0 and line == 1:
                continue
            if record.endswith(b"\r"):
                record = record[:-1]
            if not record:
                continue  # blank lines are no records
            reason, cells = None, None
            try:
                text = record.decode(self.encoding)
            except UnicodeDecodeError:
                text, reason = record.decode(self.encoding, errors="replace"), f"not {self.encoding}"
            if len(record) >= self.longest:
                reason = "too long"
            elif not closed:
                reason = "open quote"
            if reason is None:
                cells = self._cells(text)
                if isinstance(cells, str):
                    reason, cells = cells, None
                elif len(cells) > self.width:
                    reason = "more cells than the header"
            n = len(cells) if cells is not None else None
            if reason is None:
                out.append((*split, line, n, None, None, *[x or None for x in cells], *none[n:]))
            else:
                out.append((*split, line, n, reason, text, *none))
        return _batch(out, self.schema)


def _inside(lines: DataFrame, opened: frozenset, parser: _Parser) -> DataFrame:
    """The records that begin and end in one split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in walk(batches, opened, parser.sep.encode(), parser.longest):
            yield parser.rows([(at, line, have, True) for at, kind, line, have, _ in found if kind == WHOLE])

    return lines.mapInArrow(run, parser.schema)


def _across(lines: DataFrame, opened: frozenset, parser: _Parser) -> DataFrame:
    """The records that cross the border of a split: each tail with the heads
    behind it, up to the one that closes the record."""
    parts_schema = _schema("file string, block long, kind int, line long, part binary, closed boolean")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in walk(batches, opened, parser.sep.encode(), parser.longest):
            yield _batch([(*at, kind, line, have, closed) for at, kind, line, have, closed in found if kind != WHOLE],
                         parts_schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                have, closed = b"", False
                for k, p in enumerate(row["parts"]):
                    have = _longer(have, p["part"], parser.longest) if k else p["part"]
                    closed = p["closed"]
                out.append(((row["file"], row["owner"]["block"]), row["owner"]["line"], have, closed))
            yield parser.rows(out)

    upto = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("block", "line")), ignorenulls=True).over(upto)
    # grouped by record: a record's parts are cut at ``longest`` bytes each
    parts = (lines.mapInArrow(cut, parts_schema).withColumn("owner", owner).groupBy("file", "owner")
             .agg(F.sort_array(F.collect_list(F.struct("block", "kind", "part", "closed"))).alias("parts")))
    return parts.mapInArrow(join, parser.schema)


@dataclass(frozen=True)
class Records:
    """Parsed files. ``cells`` has (file, block, line, n_cells, reason,
    record, c0, c1, ...); a reason says why a record is rejected, and only
    then ``record`` holds its text."""

    header: list[str]
    cells: DataFrame

    def accepted(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """The records that fit the header, as text columns under its names
        (and the columns ``carry``). Missing last cells and empty ones are
        null."""
        return self.cells.filter("reason is null").select(
            *[F.col(f"c{k}").alias(c) for k, c in enumerate(self.header)], *carry)

    def rejected(self) -> DataFrame:
        """The others, with the place where each begins: the split's first
        byte and the line in that split, from 1."""
        return self.cells.filter("reason is not null").select("file", "block", "line", "n_cells", "reason", "record")


def _header(spark: SparkSession, path: str | list[str], sep: str, encoding: str) -> list[str]:
    """The first record of the first file that is not empty."""
    for file in sorted(map(unquote, _text(spark, path).inputFiles())):
        lines = _text(spark, "".join(f"\\{c}" if c in "[]{}*?" else c for c in file)).select(F.col("value").cast("binary"))
        rows, n, opened = [], 1, True
        while opened and len(rows) < n:
            rows = [bytes(r[0]) for r in lines.take(n)]  # of the first split
            rows[:1] = [x.removeprefix(codecs.BOM_UTF8) for x in rows[:1]]
            end, opened = 0, bool(rows)
            while opened and end < len(rows):
                opened = open_after(rows[end], end > 0, sep.encode())
                end += 1
            n = 4 * n if opened and len(rows) == n else 0
        if rows:
            record = b"\n".join(rows[:end])
            return next(csv.reader([record.decode(encoding).rstrip("\r")], delimiter=sep), [])
    return []


def unique_names(header: list[str]) -> list[str]:
    """Names of columns: repeated ones are numbered, empty ones named by
    their place."""
    out: list[str] = []
    for k, name in enumerate(header):
        name, n = name or f"_c{k}", 0
        while (f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8",
                 header: bool = True, columns: list[str] | None = None, longest: int = LONGEST_RECORD) -> Records:
    """Delimited text, every column as text, split by split.

    ``path`` is a file, a folder or a list of them. With ``header`` the first
    record of every file is its header, and the names are those of the first
    file; without it they are ``columns`` or _c0, _c1, ... The encoding is any of
    Python's that keeps ASCII bytes (UTF-8, cp949, Latin-1, ...). Blank lines
    are no records. A record is rejected if it has more cells than the header,
    is not text in the encoding, has ``longest`` bytes or more, or ends with
    an open quote.

    The driver holds the header and the splits with an open border.
    """
    if "\n,\"".encode(encoding) != b"\n,\"":
        raise ValueError(f"{encoding} does not keep ASCII bytes")
    names = columns or _header(spark, path, sep, encoding)
    if not header and not columns:
        names = [f"_c{k}" for k in range(len(names))]
    lines = _lines(spark, path)
    border = split_states(lines, sep.encode()).filter("opened or left").collect()
    opened = frozenset((r["file"], r["block"]) for r in border if r["opened"])
    parser = _Parser(sep, encoding, header, len(names), longest)
    cells = _inside(lines, opened, parser)
    if border:
        cells = cells.unionByName(_across(lines, opened, parser))
    return Records(unique_names(names), cells)
