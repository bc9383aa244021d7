"""Token counts and BPE against the tokenizers library; the empty table."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tillroll.llm.bpe import bpe_encode
from tillroll.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def expected(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in rows]


def test_counts(docs, expected):
    got = token_counts(docs, PATH, keep=["doc_id", "score", "n"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
        (i, len(t.encode()), len(x)) for i, x, t in expected)
    assert {r.score for r in got} == {"e"}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_vocabularies(docs, rows, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = token_counts(docs, path, keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], count(r[1] or "")) for r in rows)


def test_bpe(docs, expected):
    got = bpe_encode(docs, PATH, keep=["doc_id"], digests=True).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in got) == Counter(
        (i, len(x), tuple(x), t, sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, x, t in expected)


def test_empty(no_docs):
    assert token_counts(no_docs, PATH).count() == 0
    assert bpe_encode(no_docs, PATH).count() == 0


def test_vocabularies_that_do_not_fit_are_refused():
    from tillroll.llm.bpe import Vocabulary

    with pytest.raises(ValueError):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_small_blocks_change_nothing(rows, expected, monkeypatch):
    import pyarrow as pa

    from tillroll.llm import kernels as K
    from tillroll.llm.bpe import Encoder
    from tillroll.llm.token_counts import _Counter

    monkeypatch.setattr(K, "SLICE_BYTES", 5000)
    monkeypatch.setattr(K.slices, "__defaults__", (5000,))
    buf, offs = K.utf8(pa.array([r[1] for r in rows]))
    got = [ids[at[k]:at[k + 1]].tolist() for i, j, ids, at in Encoder(PATH).encode(buf, offs) for k in range(j - i)]
    assert got == [x for _, x, _ in expected]
    assert _Counter(PATH).count(buf, offs).tolist() == [len(x) for _, x, _ in expected]
