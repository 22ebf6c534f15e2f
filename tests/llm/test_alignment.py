import hashlib
from collections import Counter
from functools import lru_cache

import public_tokenizers
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), decoders.ByteLevel()


#: The table of bytes that a byte-level vocabulary writes by other characters, from the published rule.
OWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BACK = {**{chr(b): b for b in OWN}, **{chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in OWN)}}


def spelled(token):
    return bytes(BACK[c] for c in token)


def plain(text):
    """(ids of A, ids of B, groups as pairs of lists) by whole texts and sets of offsets."""
    t, sp, _ = tokenizers()
    if not text:
        return [], [], []
    e = t.encode(" " + text, add_special_tokens=False)
    b = sp.encode(text)
    a_bytes = [spelled(x) for x in e.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
    want = (" " + text).encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], [], []

    def ends(parts):
        out, at = [], 0
        for x in parts:
            at += len(x)
            out.append(at)
        return out

    a_ends, b_ends = ends(a_bytes), ends(b_bytes)
    groups, i, j = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        groups.append((e.ids[i:k], b[j:m]))
        i, j = k, m
    return e.ids, b, groups


def expected(rows):
    """By row, in the order given: the columns after doc_id."""
    all_groups = [plain(x) for x in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, _, gs in all_groups for g in gs)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for a, b, gs in all_groups:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        sha = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out.append((len(a), len(b), len(gs), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def cols(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


ODD = [*odd_texts(), " lead", "a  b ", "▁x ▁", "<s> </s> <0x0A> <|endoftext|>", "\n\n", "q\nw e\n", "a\t b\r\n\r\nc 　 d", "x\x85\n y᠎ z", "don't\n'll", "é́ ﬁ ²", "中文 字 mixed"]


def test_odd_texts(spark):
    df = docs(spark, ODD).selectExpr("*", "1 AS slice", "2 AS pairs", "3 AS n_a")
    got = {r.doc_id: cols(r) for r in alignment.align(df, A, B).collect()}
    assert got == dict(enumerate(expected(ODD)))


def test_empty_table(spark):
    assert alignment.align(docs(spark, []), A, B).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "the same text"), (1, "the same text"), (None, "the text"), (None, None), (2, "an other text")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), *cols(r)) for r in alignment.align(docs(spark, rows), A, B).collect())
    assert got == sorted(((d is None, d or 0), *x) for (d, _), x in zip(rows, expected([t for _, t in rows]), strict=True))


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: cols(r) for r in alignment.op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows]), strict=True))


@lru_cache
def aligner():
    return alignment.Aligner(A, B, kept=50)


@given(st.lists(st.text(st.sampled_from("abé \n\t\r▁<>|'s1中　\x85.,\x1c"), max_size=25), max_size=4))
@settings(max_examples=400, deadline=None)
def test_units_equal_whole_texts(texts):
    assert aligner().apart
    sizes, digests, links = aligner().slice([t.encode() for t in texts])
    at = 0
    for t, size, digest in zip(texts, sizes.tolist(), digests, strict=True):
        a, b, groups = plain(t)
        assert size == [len(a), len(b), len(groups)]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert digest == (hashlib.sha256(text.encode()).hexdigest() if groups else "")
        assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in links[at : at + len(groups)]] == [(g[0][-1], g[1][-1]) for g in groups]
        at += len(groups)
    assert at == len(links)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(0, 2))
@settings(max_examples=300, deadline=None)
def test_transducer(a, b, kept):
    """Tokens as runs of one letter: group ends are the common sums of lengths."""
    tokens = [b"x" * k for k in range(5)]
    t = alignment.Transducer(tokens, tokens, kept=kept)
    sums = [[sum(s[: k + 1]) for k in range(len(s))] for s in (a, b)]
    for _ in range(2):
        if sums[0][-1] != sums[1][-1]:
            try:
                t.groups(a, b)
            except alignment.Mismatch:
                continue
            raise AssertionError
        common = sorted(set(sums[0]) & set(sums[1]))
        assert t.groups(a, b) == [(sums[0].index(x) + 1, sums[1].index(x) + 1) for x in common]


def test_rows_stay_small(spark, monkeypatch):
    """Readers take thousands of rows at once: a row holds a bounded part of a document, never a slice of documents."""
    monkeypatch.setattr(alignment, "PART", 64)
    texts = ["word other words here " * 2000, *(f"text {k} of many, {k * k} in all" for k in range(500)), None, "last " * 64]
    df = docs(spark, texts)
    rows = alignment.sliced(df, A, B).toPandas()
    own = rows[rows.pair.isna()]
    assert own.places.map(len).max() <= 4 * 64 and len(own) > len(texts) and own.doc_id.nunique() == len(texts)
    got = {r.doc_id: cols(r) for r in alignment.align(df, A, B).collect()}
    assert got == dict(enumerate(expected(texts)))
