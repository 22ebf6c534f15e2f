from functools import lru_cache

import public_tokenizers
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")


def exact(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.MARK, prepend_scheme="always", split=True)
    return t


@lru_cache
def both():
    pieces = viterbi.vocabulary(PATH)
    return viterbi.Counter(pieces), exact(pieces)


def test_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t = both()[1]
    got = {r.doc_id: r.n_tokens for r in viterbi.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in rows.items()}


def test_odd_texts(spark):
    texts = [*odd_texts(), " lead", "a  b ", "▁x ▁", "<s> </s> <0x0A>", "\n\n", "q\nw e\n"]
    t = both()[1]
    got = {r.doc_id: r.n_tokens for r in viterbi.token_counts(docs(spark, texts).selectExpr("*", "1 AS n_tokens"), PATH).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}
    assert viterbi.token_counts(docs(spark, []), PATH).count() == 0


@given(st.text(st.sampled_from("abé \n▁<>0x中s"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    mine, t = both()
    assert mine.counts([text.encode()]).tolist() == [len(t.encode(text, add_special_tokens=False).ids)]


BYTES = [(f"<0x{k:02X}>", -50.0) for k in range(256)]


@given(st.lists(st.tuples(st.text("ab▁", min_size=1, max_size=3), st.integers(-4, 0)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.text("ab c", max_size=12))
@settings(max_examples=300, deadline=None)
def test_ties(pieces, text):
    """Small whole scores, so that many paths tie."""
    vocab = [("<unk>", 0.0), *BYTES, *((p, float(s)) for p, s in pieces)]
    want = len(exact(vocab).encode(text, add_special_tokens=False).ids)
    assert viterbi.Counter(vocab).counts([text.encode()]).tolist() == [want]
