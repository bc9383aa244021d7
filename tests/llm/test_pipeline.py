"""The pipeline's stages, each on its own input, against brute force."""
import brute
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("k", range(5))
def test_stage_takes_edge_rows(spark, docs, no_docs, rows, k):
    name, stage = P.STAGES[k]
    assert stage(spark, no_docs, SF).count() == 0
    out = stage(spark, docs, SF)
    got = out.collect()
    if k < 4:
        assert out.columns == docs.columns
    texts = [r[1] for r in rows]
    if name == "near_dedup":
        comp = brute.near_components([r[:2] for r in rows], 5)
        once = {r[:2] for r in rows if r[0] is not None and comp[r[0]] == r[0]}
        want = sorted([*once, *[r[:2] for r in rows if r[0] is None]], key=repr)
        assert sorted([(r.doc_id, r.text) for r in got], key=repr) == want
    elif name == "decontaminate":
        items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        clean = [r[:2] for r, (n, h, _) in zip(rows, brute.contaminated(texts, items)) if not (h > 0 and 20 * h >= n)]
        assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(clean, key=repr)
    elif name == "secrets":
        assert len(got) == len(rows)
        assert not any(brute.secret_spans(r.text) for r in got)
        plain = sorted([r[:2] for r in rows if not brute.secret_spans(r[1])], key=repr)
        assert sorted([(r.doc_id, r.text) for r in got if not (r.text and ("[secret]" in r.text or "[example]" in r.text))],
                      key=repr) == plain
    elif name == "encode":
        assert len(got) == len(rows) and all(len(r.ids) == r.n_tokens for r in got)
    else:
        assert 0 < len(got) <= len(rows)


def test_quality_keeps_the_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in P.quality(spark, docs, sf).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_run(spark):
    out = P.run(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
