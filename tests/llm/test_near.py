"""Near duplicates against brute force; components; registers."""
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import kernels as K
from tillroll.llm import minhash as M
from tillroll.llm.components import components


@pytest.mark.parametrize("width", [4, 5])
def test_classes(docs, rows, width):
    got = M.near_duplicates(docs, width=width).collect()
    comp = brute.near_components([r[:2] for r in rows], width)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(
        (r[0], len(brute.shingles(r[1], width)), comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r in rows)


def test_group_of_near_copies_without_a_hub(spark):
    """Many near copies, few of them linked: both rounds and the blocks."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6, 8])):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i * 7 % 400, " ".join(w)))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near_components(rows, 4)


def test_empty(no_docs):
    out = M.near_duplicates(no_docs)
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_bounds_keep_every_similar_pair():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for size in (2, 5, 20, 150, 900, 3000):
        for _ in range(40):
            a = rng.choice(pool, size, replace=False)
            b = np.unique(np.append(a[max(1, size // 10):], rng.choice(pool, size // 12, replace=False)))
            a = np.unique(a)
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (M.registers(s, np.array([0, len(s)])) for s in (a, b))
            if 100 * j >= 80:
                assert M.may_reach(x, y, np.array([len(a)]), np.array([len(b)]), 80)[0]


def test_borrowed_registers_are_all_filled():
    buf, offs = K.utf8(pa.array(["a b c d e", "one", "", "x y z u v w " * 40]))
    reg = M.registers(*M.shingle_sets(buf, offs, 4))
    full = M.filled(reg)
    assert (full[[0, 1, 3]] > 0).all() and (full[2] == 0).all()
    assert (full[reg > 0] == reg[reg > 0]).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    links += [(500, None), (None, 501), (502, 502), (5, 0), (5, 0)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            par[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in par}
    assert len(got) == len(par)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
