"""Quoted delimited files, read split by split, against the csv module."""
import csv
import io
import random

import pytest

from tillroll.sources import delimited as D
from tillroll.sources import ingest as G

CELLS = ["", "a", "plain text", 'say "hi"', "x,y", "two\nlines", "\n", '"', '""', 'end"', ",", "한글", "l\r\nr", "a\n\"b\",\nc"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, several to a file."""
    conf = {"spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "1b"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _file(path, rows, encoding="utf-8", bom=b"", end="\n", sep=","):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, delimiter=sep).writerows(rows)
    path.write_bytes(bom + out.getvalue().encode(encoding))


def _got(records):
    return sorted(map(tuple, records.accepted().collect()), key=repr)


def _want(rows):
    return sorted((tuple(x or None for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_cells_across_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    head, rows = ["id", "one", "two\nlined", "four"], []
    for part in range(3):
        own = [[f"{part}.{k}", *rng.choices(CELLS, k=2), "x" * rng.choice([0, 3, 90])] for k in range(60)]
        if part == 1:
            own[30][1] = "line\n" * 300  # a cell over several splits
        rows += own
        _file(tmp_path / f"p{part}.csv", [head, *own], bom=b"\xef\xbb\xbf" if part == 2 else b"")
    (tmp_path / "empty.csv").write_bytes(b"")
    got = D.read_records(spark, str(tmp_path))
    assert got.header == head
    splits = D.split_states(D._lines(spark, str(tmp_path)), b",")
    assert splits.filter("opened").count() > 3 and splits.count() > 20
    assert _got(got) == _want(rows)
    assert got.rejected().count() == 0


@pytest.mark.parametrize("encoding,sep,end", [("cp949", "\t", "\r\n"), ("utf-8", ",", "\r\n"), ("latin-1", ";", "\n")])
def test_encodings_and_line_ends(spark, tmp_path, small_splits, encoding, sep, end):
    rows = [[str(k), "가\n나" if encoding != "latin-1" else "é\nü", 'q "q"', ""] for k in range(60)]
    _file(tmp_path / "a.txt", [["a", "b", "b", ""], *rows], encoding, end=end, sep=sep)
    got = D.read_records(spark, str(tmp_path / "a.txt"), sep, encoding)
    assert got.header == ["a", "b", "b.1", "_c3"]
    assert _got(got) == _want(rows)


def test_records_that_do_not_fit(spark, tmp_path, small_splits):
    lines = [b"a,b", *[b"%d,x" % k for k in range(100)], b"1,2,3", b"short", b"", b"\r", b'"q"tail,5" pipe', b"\xff\xfe,1",
             b'7,"never closed', b"8,y"]
    (tmp_path / "a.csv").write_bytes(b"\n".join(lines))
    got = D.read_records(spark, str(tmp_path / "a.csv"))
    bad = {r.reason: r for r in got.rejected().collect()}
    assert set(bad) == {"more cells than the header", "not utf-8", "open quote"}
    assert bad["more cells than the header"].n_cells == 3 and bad["more cells than the header"].record == "1,2,3"
    assert bad["open quote"].record == '7,"never closed\n8,y' and bad["open quote"].file.endswith("a.csv")
    start = (tmp_path / "a.csv").read_bytes()[bad["open quote"].block:]
    assert b'7,"never' in b"\n".join(start.split(b"\n")[:bad["open quote"].line + 1])
    assert _got(got) == _want([[str(k), "x"] for k in range(100)] + [["short", ""], ["qtail", '5" pipe']])


def test_a_record_that_is_too_long(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'a,b\n1,"' + b"x\n" * 2000 + b'"\n2,y\n')
    got = D.read_records(spark, str(tmp_path / "a.csv"), longest=1000)
    assert [r.reason for r in got.rejected().collect()] == ["too long"]
    assert _got(got) == [("2", "y")]


def test_empty_and_headless(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert D.read_records(spark, str(tmp_path / "a.csv")).accepted().columns == []
    (tmp_path / "b.csv").write_bytes(b"x,1\ny,2\n")
    assert _got(D.read_records(spark, str(tmp_path / "b.csv"), header=False)) == [("x", "1"), ("y", "2")]
    named = D.read_records(spark, str(tmp_path / "b.csv"), header=False, columns=["n", "v"])
    assert named.accepted().columns == ["n", "v"]
    with pytest.raises(ValueError, match="ASCII"):
        D.read_records(spark, str(tmp_path / "b.csv"), encoding="utf-16")


def test_quote_automaton_agrees_with_the_csv_module():
    rng = random.Random(9)
    for _ in range(5000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 9)))
        opened = D.open_after(line.encode(), False, b",")
        read = list(csv.reader([line, 'z"']))  # an open cell takes the next line in
        assert opened == (len(read) == 1 if line else False), line
        # inside: as if the cell had been opened by a line before
        inside = D.open_after(line.encode(), True, b",")
        read = list(csv.reader(['"k', line, 'z"']))
        assert inside == (len(read) == 1), line


def test_read_delimited_and_sheets(spark, tmp_path):
    _file(tmp_path / "a.csv", [["상품명", "판매량"], ['a ""big"" one', "3"], ["two\nlines", "4"]])
    got = G.read_delimited(spark, str(tmp_path / "a.csv")).collect()
    assert sorted(map(tuple, got)) == [('a ""big"" one', "3"), ("two\nlines", "4")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    sheet = G.read_sheets(spark, {"의류": str(tmp_path / "a.csv")}).collect()
    assert {r.data_type for r in sheet} == {"의류"}
