import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def check(rows, want, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for doc, own in by_doc.items():
        ids, at = ids_of(want[doc]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_odd_texts(spark):
    texts = odd_texts()
    rows = packing.pack(docs(spark, texts), PATH, 64).collect()
    check(rows, dict(enumerate(texts)), 64)


def test_empty_table(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    df = docs(spark, [(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 AS length", "2 AS number", "3 AS __b")
    rows = packing.pack(df, PATH, 64).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in rows) == [(False, 1, 3), (False, 1, 3), (True, None, 2)]
    assert sorted(r.offset for r in rows) == [0, 2, 5] or sorted(r.offset for r in rows) == [0, 3, 6] or len({r.sequence_id for r in rows}) == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.op5_pack(spark, sf).collect()
    seqs = check(rows, {r.doc_id: r.text for r in df.collect()}, 4096)
    total = sum(n for own in seqs.values() for _, n in own)
    assert len(seqs) <= total / 4096 * 1.01 + 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8), st.integers(30, 40))
@settings(max_examples=150, deadline=None)
def test_plan_uses_all_and_fills_best(counts, capacity):
    patterns = packing.plan(counts, capacity)
    used = Counter()
    left = Counter(counts)
    for times, p in patterns:
        assert sum(k * c for k, c in p.items()) <= capacity
        largest = max(k for k, c in left.items() if c)
        others = left - Counter({largest: 1})
        reach = {0}
        for k, c in others.items():
            for _ in range(c):
                reach |= {x + k for x in reach if x + k <= capacity - largest}
        assert sum(k * c for k, c in p.items()) == largest + max(reach)
        for k, c in p.items():
            used[k] += c * times
            left[k] -= c * times
    assert used == Counter(counts)


@given(st.lists(st.text(st.sampled_from("aBé.,'s1 İσΣ\n\t²ªé…-<|end>")), max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_tokenizer(texts):
    e = packing.encoder(PATH)
    ids, lens = e.encode([t.encode() for t in texts])
    want = [ids_of(t)[:-1] for t in texts]
    assert lens.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_encoder_forgets_and_stays_right():
    e = packing.Encoder(PATH, kept=60)
    for k in range(30):
        texts = [" ".join(f"w{(k * 7 + i * j) % 200}x" for i in range(20)) + " common words, here." for j in range(5)]
        ids, _ = e.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in ids_of(t)[:-1].tolist()]
        assert len(e.at) <= 60 + 110
