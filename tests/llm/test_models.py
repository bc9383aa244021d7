"""Language model, quality classifier, archives, Elias-Fano."""
import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import elias_fano as ef
from tillroll.llm import kernels as K
from tillroll.llm import language_model as LM
from tillroll.llm.language_model import PRIOR, lm_scores
from tillroll.llm.quality import STATISTICS, RuleModel, fit, quality_scores, train
from tillroll.llm.warc import archive_round_trip, read_archives, write_archives


@pytest.mark.parametrize("n,top", [(0, 5), (1, 0), (1000, 10**6), (3000, 1 << 50), (3, 1 << 40), (300, 300)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top + 1, n)).astype(np.uint64)
    s = ef.build(v, top)
    assert (ef.values(s) == v).all()
    if len(v):
        assert (ef.get(s, np.arange(len(v))) == v).all()
        q = np.append(rng.integers(0, top + 1, 400).astype(np.uint64), v)
        at, same = ef.successor(s, q)
        assert (same == np.isin(q, v)).all() and (at == np.searchsorted(v, q)).all()


def _brute_scores(rows, order):
    toks = [(i, [*brute.words(t), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in toks]
    c = [Counter() for _ in range(order + 1)]
    for (i, w), h in zip(toks, held):
        if not h:
            for k in range(1, order + 1):
                c[k].update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    n, v = sum(c[1].values()), len(c[1])

    def p(g):
        if len(g) == 1:
            return (c[1][g] + 0.1) / (n + 0.1 * (v + 1))
        return (c[len(g)][g] + PRIOR * p(g[1:])) / (c[len(g) - 1][g[:-1]] + PRIOR)

    for (i, w), h in zip(toks, held):
        yield (i, h, len(w), sum(c[1][(t,)] > 0 for t in w), n, sum(math.log10(p((t,))) for t in w),
               sum(math.log10(p(tuple(w[max(0, j - order + 1):j + 1]))) for j in range(len(w))))


@pytest.mark.parametrize("order", [1, 3])
def test_language_model(docs, rows, order):
    got = sorted(map(tuple, lm_scores(docs, order=order).collect()), key=repr)
    want = sorted(_brute_scores([r[:2] for r in rows], order), key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=2e-4 * w[2] + 1e-6)


def _word_with_key(key):
    """The word hash whose 64-bit n-gram hash of order 1 is ``key``."""
    def back(x, shift):
        y = x
        for _ in range(64 // shift):
            y = x ^ (y >> shift)
        return y

    x = back(key, 31) * pow(0x94D049BB133111EB, -1, 1 << 64) % (1 << 64)
    x = back(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) % (1 << 64)
    x = back(x, 30)
    base = 0xD6E8FEB86659FD93
    return (x - (base ^ (base >> 29)) * 0x9FB21C651E98DF25) % (1 << 64)


def test_words_meet_no_other_ngram(monkeypatch):
    a, b = 12345, 67890
    pair = int(K.chain_hash(np.array([a, b], np.uint64), 2)[0])
    # two words that agree in 56 bits with the bigram (a, b), and with each other
    near, next_ = (_word_with_key(pair ^ x) for x in (1, 2))
    h = np.array([a, b, a, b, near, next_], np.uint64)
    assert len({int(x) >> 8 for x in K.chain_hash(h[4:], 1)} | {pair >> 8}) == 1
    rows = np.zeros(6, np.int64)
    ends, uniq, words, inv = LM._entries(h, rows, 3, 144)
    assert len(words) == 4 and len(uniq) == len(set(uniq.tolist()))
    assert np.bincount(inv)[inv[:6]].tolist() == [2, 2, 2, 2, 1, 1]
    monkeypatch.setattr(LM, "tokens", lambda text: (h, rows))
    docs = pa.table({"text": ["any"], "held_out": [False]})
    asked = pa.Table.from_batches(LM._ask(0, docs, 3, 144))
    assert len(asked) and max(asked.column("shard").to_pylist()) >= 144
    # a group that asks twice: totals of both, for words and longer n-grams alike
    for k in range(asked.num_rows):
        one = asked.slice(k, 1)
        got = LM._answer(pa.concat_tables([one, one]))
        own = LM._counts_in(one.column("counts").to_pylist(), one.column("large").to_pylist())
        for row in range(2):
            each = got.slice(row, 1)
            assert (LM._counts_in(each.column("counts").to_pylist(), each.column("large").to_pylist()) == 2 * own).all()


def test_counts_beyond_a_byte():
    c = np.array([0, 254, 255, 256, 10 ** 12, 3, 255], np.int64)
    small, big = LM._counts_out(c, np.array([0, 2, 2, 5, 7]))
    assert [len(x) for x in small.to_pylist()] == [2, 0, 3, 2] and [len(x) for x in big.to_pylist()] == [0, 0, 24, 8]
    assert (LM._counts_in(small.to_pylist(), big.to_pylist()) == c).all()


def test_rising_numbers_come_back():
    rng = np.random.default_rng(4)
    for top in (1 << 3, 1 << 20, 1 << 41, 1 << 63):
        parts = [np.unique(rng.integers(0, top, int(n), dtype=np.uint64)) for n in (0, 1, 5, 0, 0, 300, 2, 0)]
        cells = LM._keys_out(np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])))
        for x, cell in zip(parts, cells.to_pylist()):
            assert (LM._keys_in(cell) == x).all()


@pytest.mark.parametrize("order,shards", [(1, 1), (2, 5), (3, 700), (4, 3)])
def test_slices_score_like_the_whole(monkeypatch, order, shards):
    """A group's scores do not depend on where it is cut."""
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdefg"), int(n))) for n in rng.integers(0, 60, 40)]
    docs = pa.table({"id": pa.array(range(40)), "text": texts, "held_out": rng.random(40) < 0.2})
    blocks = pa.table({"block": pa.chunked_array([pa.array([LM._pack(docs.slice(0, 25)), LM._pack(docs.slice(25))], pa.binary())])})
    asked = pa.Table.from_batches(LM._ask(0, docs, order, shards))
    back = pa.concat_tables([LM._answer(asked.slice(k, 1)) for k in range(asked.num_rows)])
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out = []
    for size in (1 << 20, 50, 7):
        monkeypatch.setattr(LM, "SLICE", size)
        out.append(LM._score(blocks, back, order, shards, 1000, 8, schema).to_pydict())
    assert out[0] == out[1] == out[2]
    assert all(s < 0 for s in out[0]["score"])


def test_language_model_empty(spark, no_docs):
    assert lm_scores(no_docs).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert r.base_score == pytest.approx(0.0, abs=1e-9)


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels)
    assert 0 < len(model.rules) < 400
    test = docs.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = quality_scores(test, model, keep=["doc_id", "quality"]).toPandas()
    assert len(got) > 500
    assert (got.predicted == got.quality).mean() > 0.97
    assert (got[got.quality == 0].predicted == 0).mean() > 0.9


def test_quality_edges(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(r[0], 0 if r[0] is not None and r[0] % 3 == 0 else 1) for r in rows] + [
        (None, 1), (5, None)], "doc_id long, quality int")
    model = train(docs, labels)
    got = quality_scores(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if not r.text}) == 1  # null as empty
    none = train(docs, labels.limit(0))
    assert {r.predicted for r in quality_scores(docs, none).collect()} == {1}
    assert quality_scores(no_docs, model).count() == 0
    one = fit(np.zeros((50, len(STATISTICS))), np.zeros(50))
    assert one.probability(np.zeros((1, len(STATISTICS))))[0] < 0.1


def test_column_equals_model(spark, docs):
    from tillroll.llm.quality import text_statistics

    rng = np.random.default_rng(0)
    rows = text_statistics(docs, "text", ["doc_id"]).toPandas()
    x = rows[[f"__s{k}" for k in range(len(STATISTICS))]].to_numpy()
    x = np.repeat(x, 3, axis=0)
    model = fit(x, (x[:, 1] + rng.normal(0, 0.5, len(x)) > np.median(x[:, 1])).astype(float))
    assert model.rules
    got = text_statistics(docs, "text", ["doc_id"]).withColumn("score", model.column()).toPandas()
    y = got[[f"__s{k}" for k in range(len(STATISTICS))]].to_numpy()
    assert np.allclose(got.score, model.probability(y), atol=1e-9)


PAGES = "page_id long, url string, html string, payload_digest string, block string"


def _pages():
    big = "<html>" + "x\r\n\r\nWARC/1.1\r\n" * 100 + "é</html>"
    other = "<p>" + "y" * 1200
    rows = [(k, f"http://a.example/{k} \r\n x", big) for k in (3, 9, 5)] + [(9, "u", big)]
    rows += [(20, None, other), (21, "u", other), (None, "u", other), (30, "u", "small"), (31, "u", "small"), (32, "u", None),
             (33, "u", ""), (None, None, None), (40, "u", "z" * 999), (41, "u", "z" * 999), (42, "u", "\r\n\r\n" * 400)]
    return [(*r, "e", "e") for r in rows]


def test_archives(spark):
    rows = _pages()
    got = archive_round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    best = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, -1), i)
    want = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        again = b in best and best[b] != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    assert Counter(map(tuple, got)) == Counter(want)


def test_payloads_come_back(spark, tmp_path):
    rows = _pages()
    write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w")).filter("record_type = 'response'").collect()
    assert {r.payload for r in got} == {r[2] or "" for r in rows}
    assert all(r.stated_digest == r.payload_digest == hashlib.sha1(r.payload.encode()).hexdigest() for r in got)


def test_archives_empty(spark):
    assert archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def _random_model(rng, trees=60):
    rules = {}
    for _ in range(trees):
        path = tuple((int(rng.integers(len(STATISTICS))), bool(rng.integers(2)), float(rng.random())) for _ in range(3))
        rules |= {path[:k]: None for k in (1, 2, 3)}
        rules[(*path[:2], (path[2][0], not path[2][1], path[2][2]))] = None
    return RuleModel(list(rules), [float(w) for w in rng.normal(size=len(rules))], float(rng.normal()))


def test_scores_are_those_of_the_rules(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.random((200, len(STATISTICS))), np.zeros((1, len(STATISTICS)))])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)],
                               ["k", *[f"__s{k}" for k in range(len(STATISTICS))]])
    for model in (_random_model(rng), RuleModel([], [], 40.0), RuleModel([], [], -0.3)):
        got = [r.score for r in df.select("k", model.column().alias("score")).orderBy("k").collect()]
        assert got == pytest.approx(model.probability(x), abs=1e-12)


def test_scores_leave_nothing_in_the_driver(spark):
    """Plans of large models, one after the other, without what the parser would
    keep of each (about 17 MB for one of these)."""
    rng = np.random.default_rng(9)
    df = spark.range(1).select(*[F.rand(k).alias(f"__s{k}") for k in range(len(STATISTICS))])
    jvm = spark._jvm.java.lang

    def used():
        for _ in range(3):
            jvm.System.gc()
        run = jvm.Runtime.getRuntime()
        return (run.totalMemory() - run.freeMemory()) / 1e6

    df.select(_random_model(rng).column()).schema  # noqa: B018
    before = used()
    for _ in range(2):
        df.select(_random_model(rng).column()).schema  # noqa: B018
    assert used() - before < 15
