import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCAB = bpe.Vocabulary(bpe.default_path())
REAL = tokenizers.Tokenizer.from_file(bpe.default_path())


def real(text):
    ids = REAL.encode(text, add_special_tokens=False).ids
    return ids, REAL.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=60) | st.text(alphabet="aab <|>endoftext'sllre\n\t01Σİ é", max_size=60))
def test_like_the_library(text):
    ids = list(VOCAB.encode(text))
    assert (ids, VOCAB.decode(ids)) == real(text)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 2000, "<|endoftext|>x<|startoftext|>", "don't I'LL we've"])
def test_long_words_and_special_tokens(text):
    assert list(VOCAB.encode(text)) == real(text)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdelnorstué", min_size=1, max_size=70), min_size=1, max_size=20))
def test_trees_side_by_side_merge_like_one(words):
    assert VOCAB.word_ids(words) == [VOCAB.merge(VOCAB.start_ids(w)) for w in words] == [real(w)[0] for w in words]


def test_odd_rows(odd, clashing, empty):
    for r in bpe.encoded_digest(odd).collect():
        assert r.n_tokens >= 0
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded_digest(odd).collect()}
    expect = set()
    for d, t in odd.select("doc_id", "text").collect():
        ids, text = real(t or "")
        expect.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows == expect
    assert bpe.encode(empty).count() == 0
    out = bpe.encode(clashing)
    assert out.count() == odd.count() and out.columns[-2:] == ["ids", "decoded"]
