import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import tokens

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e) for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query(spark, sf, docs):
    from spindrift.llm.queries import op4_tokens

    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]), strict=True)}
    for r in op4_tokens(spark, sf).collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 512)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_and_cut(name, monkeypatch):
    texts = ["", "<|endoftext|> a<|endoftext|>", "  two  blanks\n\n\n x", "word " * 3000, "x" * 9000, "é" * 500 + " " + "ü", "a\t b\r\n c'll d", "1 2 3. 4! 5? 6"]
    lib = Tokenizer.from_file(P.path(name))
    monkeypatch.setattr(tokens.pieces, "__defaults__", (16,))
    assert tokens.count(texts, P.path(name)).tolist() == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1.' \n\té日<|endoftext>", max_size=120))
def test_pieces_keep_counts(text):
    parts = list(tokens.pieces(text, 4))
    assert "".join(parts) == text
    assert sum(library(parts)) == library([text])[0]


def test_odd_and_empty(odd, empty):
    got = tokens.with_token_counts(odd, PATH).collect()
    assert [r.n_tokens for r in got] == library([r.text for r in got])
    assert all(r.n_bytes == len((r.text or "").encode()) for r in got)
    assert tokens.with_token_counts(empty, PATH).count() == 0
