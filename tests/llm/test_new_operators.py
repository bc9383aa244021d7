"""Whitening, the n-gram join and periodic runs against plain versions."""
import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import kernels as K
from tillroll.llm import ngram_join as J
from tillroll.llm import periodic as P
from tillroll.llm import queries as Q
from tillroll.llm import whitening as W

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, component string, n string, id string, deviation string, ids string, m string"


# --- whitening ---------------------------------------------------------------------------
def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "e", "e", "e", "e", "e", "e") for r in rows], VECTORS).repartition(4)


def _plain_whitening(vectors, k):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    a = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    w, u = np.linalg.eigh(a.T @ a / n)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    return dev, a @ u / np.sqrt(w), w / np.trace(a.T @ a / n)


@pytest.mark.parametrize("dim,k", [(40, 8), (64, 3), (5, 8)])
def test_whitening_against_eigh(spark, dim, k):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((300, dim)) * np.linspace(3, 0.3, dim) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    a[7] = a[3]
    good = [(i, v.tolist()) for i, v in enumerate(a)] + [(None, a[9].tolist()), (5, a[5].tolist())]
    bad = [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [1.0] * (dim - 1)),
           (905, [float("inf")] + [0.0] * (dim - 1))]
    got = W.whiten(_vectors(spark, good + bad), components=k).collect()
    dev, white, share = _plain_whitening([v for _, v in good], k)
    k = min(k, dim)
    assert len(got) == len(good) * k and {r.n for r in got} == {len(good)}
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == Counter(
        (i, d) for (i, _), d in zip(good, dev))
    assert max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), r)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
    for c in range(1, k + 1):
        mine = np.array([by[i, c].whitened for i, _ in good])
        sign = np.sign((mine * white[:, c - 1]).sum())
        assert np.abs(mine * sign - white[:, c - 1]).max() < 1e-8


def test_whitening_of_little(spark):
    assert W.whiten(_vectors(spark, [])).count() == 0
    assert W.whiten(_vectors(spark, [(1, None)])).count() == 0
    assert W.whiten(_vectors(spark, [(1, [1.0, 2.0])])).count() == 0        # no variance
    got = W.whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])).collect()
    assert {r.component for r in got} == {1}                                 # rank one
    assert abs(sum(r.whitened ** 2 for r in got) / 6 - 1) < 1e-9


def test_deviations_are_exact_beyond_64_bits():
    n, sums = 3_000_000_000, [7 * 3_000_000_000 + 11, -5]
    centre = W._Centre(n, sums)
    x = np.array([[7, 0], [100_000, -3], [W.LIMIT, -W.LIMIT]])
    for rows in (x[:2], x):  # three limbs, then plain integers
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in rows]
        got = centre.deviations(rows)
        assert [None if w >= 10 ** 38 else w for w in want] == [None if v is None else int(v) for v in got]


def test_a_close_spectrum_is_certified():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.concatenate([[30, 29.5, 29.4, 20, 19.99, 19.9, 19.8, 19.7], np.linspace(19.5, 1, 82)])
    x = (rng.standard_normal((4000, 90)) * np.sqrt(values) @ q.T * 1024).astype(np.int64)
    old = W._moments, W._summed
    try:
        W._moments = lambda b, d: (len(x), [int(v) for v in x.sum(0)])
        W._summed = lambda b, d, r, c, product: product(x)
        got = W.leading_spectrum(None, 90, 8)
    finally:
        W._moments, W._summed = old
    c = x - x.mean(0)
    w, u = np.linalg.eigh(c.T @ c / len(c))
    assert np.abs(got.values / w[::-1][:8] - 1).max() < 1e-12
    assert np.abs(np.abs((got.vectors * u[:, ::-1][:, :8]).sum(0)) - 1).max() < 1e-10


def test_query_op11(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    dev, white, share = _plain_whitening([[float(c) for c in r.embedding] for r in rows], 8)
    got = Q.op11_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    at = {r.vec_id: k for k, r in enumerate(rows)}
    got = got.collect()
    assert len(got) == 8 * len(rows) and all(r.deviation == dev[at[r.vec_id]] for r in got)
    assert all(abs(abs(r.whitened) - abs(white[at[r.vec_id], r.component - 1])) < 1e-7 for r in got)


# --- n-gram join ---------------------------------------------------------------------------
@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_against_brute_force(docs, rows, width, percent):
    got = J.linked_documents(docs, width=width, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    comp = brute.near_components([r[:2] for r in rows], width, percent)
    assert Counter(map(tuple, got.collect())) == Counter(
        (r[0], len(brute.shingles(r[1], width)), comp.get(r[0])) for r in rows)


def test_join_of_groups_without_a_hub_and_of_common_passages(spark):
    """Near copies that are linked by chains only, a passage that a third of
    all texts share, sets of threshold similarity, repeated rows."""
    rng = random.Random(5)
    base, shared = [f"b{k}" for k in range(120)], [f"s{k}" for k in range(60)]
    texts = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        texts.append(w)
    for i in range(150):
        texts.append(shared + [f"u{i}.{k}" for k in range(rng.choice([2, 3, 9, 40]))])
    for n in (6, 7, 20, 100):
        for cut in range(1, 5):
            texts += [[f"t{n}.{cut}.{k}" for k in range(n)], [f"t{n}.{cut}.{k}" for k in range(cut, n + cut - 1)]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += rows[:30] * 3
    got = J.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(rows, 4, 85)
    assert len(got) == len(rows)


def test_join_empty(no_docs):
    assert J.linked_documents(no_docs).count() == 0


def test_prefixes_of_similar_sets_meet_in_every_order():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 5, J.CELLS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.append(x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)))
        same = len(np.intersect1d(x, y))
        if 100 * same < 85 * len(np.union1d(x, y)):
            continue
        px, py = J.prefixes(x, classes, 85), J.prefixes(y, classes, 85)
        for u, v in zip(px, py):
            both, ax, ay = np.intersect1d(u, v, return_indices=True)
            assert len(both)
        _, ax, ay = np.intersect1d(px[0], py[0], return_indices=True)
        assert J._bounded(len(x), len(y), ax, ay, 85).all()


def test_similar_sets_pass_the_bounds_where_they_first_meet():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, 40, J.CELLS).astype(np.uint8)
    passed = pruned = 0
    for _ in range(600):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        keep, more = rng.choice([1, 0.97, 0.9, 0.6]), int(rng.integers(0, 1 + n // 10))
        y = np.unique(np.append(x[rng.random(len(x)) < keep], rng.integers(0, 1 << 64, more, dtype=np.uint64)))
        same = len(np.intersect1d(x, y))
        wx, wy = J.parity(np.append(x, y), np.array([0, len(x), len(x) + len(y)]))
        differ = int(np.bitwise_count((wx ^ wy).view(np.uint64)).sum())
        assert differ <= len(x) + len(y) - 2 * same
        near = J._near_bits(len(x), len(y), differ, 85)
        if same and 100 * same >= 85 * len(np.union1d(x, y)):
            _, ax, ay = np.intersect1d(J.prefixes(x, classes, 85, 1)[0], J.prefixes(y, classes, 85, 1)[0], return_indices=True)
            assert near and J._bounded_first(len(x), len(y), ax[0], ay[0], 85)
            passed += 1
        else:
            pruned += not near
    assert passed > 100 and pruned > 100
    assert J.parity(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [[0] * J.WORDS]


def test_compact_lists_bound_the_intersection():
    rng = np.random.default_rng(8)
    pairs = [(np.zeros(0, np.uint64), np.arange(3, dtype=np.uint64))]
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in rng.integers(1, 400, 2))
        pairs.append((x, np.unique(np.append(y, x[rng.random(len(x)) < rng.random()]))))
    cells = [pa.array([J.compact(v) for v in side], pa.binary()) for side in zip(*pairs)]
    most, nx, ny = J.most_common(*cells)
    assert nx.tolist() == [len(x) for x, _ in pairs] and ny.tolist() == [len(y) for _, y in pairs]
    for (x, y), m in zip(pairs, most):
        same = len(np.intersect1d(x, y))
        assert same <= m <= same + 5 + 0.1 * min(len(x), len(y))
    assert J.most_common(cells[0].slice(0, 0), cells[1].slice(0, 0))[0].tolist() == []


def test_shared_entries_of_all_orders():
    rng = np.random.default_rng(6)
    x, y = [], []
    for _ in range(300):
        x.append(rng.integers(0, 12, (J.ORDERS - 1, int(rng.integers(1, 4)))).astype(np.uint16))
        y.append(rng.integers(0, 12, (J.ORDERS - 1, int(rng.integers(1, 4)))).astype(np.uint16))
    want = [all(len(np.intersect1d(u, v)) for u, v in zip(a, b)) for a, b in zip(x, y)]
    cells = [pa.array([v.tobytes() for v in side], pa.binary()) for side in (x, y)]
    assert J.share_all(*cells).tolist() == want and any(want) and not all(want)


def test_classes_rank_common_shingles_last(spark):
    rows = [(i, "one two three four " + f"x{i} y{i} z{i} v{i}") for i in range(400)]
    src = spark.createDataFrame(rows, "id long, text string").repartition(3)
    classes = J.frequency_classes(src, 4)
    buf, offs = K.utf8(pa.array([rows[0][1]]))
    s, _ = J.shingle_sets(buf, offs, 4)
    assert sorted(classes[J._cell(s)] > 0) == [False] * 4 + [True]
    common = classes[J._cell(s)] > 0
    p = J.prefixes(s, classes, 20)  # all but the last places
    assert all(np.uint64(1) << np.uint64(58) <= v[-1] for v in p) == bool(common.any())


# --- periodic runs ---------------------------------------------------------------------------
def _plain_runs(w, shortest=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                out.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted(((s, n_, q) for (s, n_), q in out.items()), key=lambda r: (r[0], r[2]))


def _plain_row(text):
    w = __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = _plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def _run_texts():
    rng = random.Random(4)
    out = ["a " * 30, "a b " * 40 + "c " + "a b " * 40, "x " * 11, "x " * 12, "A a " * 9, "p q r s t u " * 2]
    for _ in range(60):
        w = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 3)):
            w = w[:rng.randint(1, len(w))] * rng.randint(1, 4) + [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def test_runs_against_plain_search(spark, docs, rows):
    texts = [(50_000 + i, t) for i, t in enumerate(_run_texts())]
    wide = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    wide = wide.withColumns({c: F.lit("e") for c in ("runs", "n_words", "collapsed", "id")})
    got = P.periodic_runs(wide, digests=True).collect()
    want = Counter()
    for i, t in [r[:2] for r in rows] + texts:
        if t and len(t) > 40_000:
            continue  # the plain search is square
        n, runs, kept = _plain_row(t)
        want[i, n, tuple(runs), kept, hashlib.sha256(kept.encode()).hexdigest()] += 1
    mine = Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed, r.collapsed_sha256)
                   for r in got)
    assert not want - mine
    assert sum(mine.values()) == len(rows) + len(texts)
    assert P.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_run_search_with_few_cells(monkeypatch, cells):
    monkeypatch.setattr(P, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 3)):
            w = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))]
            texts.append((w * rng.randint(1, 4))[:100] + w)
        cut = np.append(0, np.cumsum([len(w) for w in texts]))
        h = K.mix(np.array([x + 1 for w in texts for x in w], np.uint64))
        got = list(zip(*(v.tolist() for v in P.find_runs(h, cut))))
        assert got == [(s + int(c), n, q) for w, c in zip(texts, cut) for s, n, q in _plain_runs(w)]


def test_query_op13(spark):
    got = {r.doc_id: r for r in Q.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        _, runs, kept = _plain_row(" ".join(w))
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5
