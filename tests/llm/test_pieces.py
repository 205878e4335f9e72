import hashlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def enc():
    return pieces.encoder(pieces.default_model())


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdeth ▁\n\t\r.éß日本語🙂\x00<s>0x41", max_size=40)))
def test_ids_are_the_library_s(enc, text):
    assert array("I", enc.encode(text)).tolist() == enc.sp.encode(text, add_bos=True, add_eos=True)


def test_pair_test_agrees_with_merging(enc):
    import random

    rng, names = random.Random(1), [p for p in enc.ids if len(p) < 8 and enc._merge(p, {}) == [p]]
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        assert enc._fit(enc.ids[a], enc.ids[b]) == (enc._merge(a + b, {}) == [a, b]), (a, b)


def test_edges(documents, clashing, edges, enc):
    rows = pieces.encode_documents(clashing(documents(edges)), keep=True).collect()
    assert len(rows) == len(edges)
    want = sorted((i if i is not None else -1, tuple(enc.sp.encode(t or "", add_bos=True, add_eos=True))) for i, t in edges)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"])) for r in rows) == want
    for r in rows:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(array("I", r["ids"]).tobytes()).hexdigest()
        assert r["decoded"] == enc.sp.decode(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_empty_table(documents):
    assert pieces.encode_documents(documents([])).collect() == []
