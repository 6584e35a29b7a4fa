import hashlib

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import pieces

PATH = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def library(text):
    ids = LIB.encode(text or "")
    return ",".join(map(str, ids)), len(ids), LIB.decode(ids) if ids else ""


def whole(model, text):
    ids = model.encode(text)
    return model.joined(ids), len(ids), model.decode(ids)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query(spark, sf, docs):
    from spindrift.llm.queries import op6_pieces

    want = {r.doc_id: library(r.text) for r in docs.collect()}
    for r in op6_pieces(spark, sf).collect():
        ids, n, back = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(back))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ▁\n\té日🙂<s>/0x\x00ﬁ", max_size=60))
def test_any_text(text):
    assert pieces.Pieces(PATH).by_chunk
    assert whole(pieces.pieces(PATH), text) == library(text)


def test_table_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    p = pieces.Pieces(PATH)
    for text in ["a b c d e f g", "h i j", "a a b", "", " ", "x" * 2000, "a h i  j k l m n o p", "b"] * 3:
        assert whole(p, text) == library(text) and len(p.young) <= 12 and len(p.old) <= 12


def test_odd_and_empty(odd, empty):
    for r in pieces.with_pieces(odd, PATH, ids="pieces", decoded="back").collect():
        ids, n, back = library(r.text)
        assert (",".join(map(str, r.pieces)), r.n_tokens, r.back) == (ids, n, back)
    assert pieces.with_pieces(empty, PATH).count() == 0
