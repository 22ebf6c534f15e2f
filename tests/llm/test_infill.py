import hashlib
import re

import duckdb
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import infill


def expected(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    sha = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return (doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def agree(df, rows):
    out = infill.infill(df)
    got = out.select("*", infill.restored(out.output, out.form).alias("back")).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(expected(d, t)) for d, t in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_odd_texts(spark):
    texts = [*odd_texts(), "<P> in it", "<S", "S> <", "a" * 100_000, "." * 40, "ab " * 16, "ab " * 17, "x1" * 16 + "y", "\U0001f600" * 33, "é" * 65, "<" * 64]
    rows = list(enumerate(texts)) + [(100 + k, t) for k, t in enumerate(texts)] + [(10**9 + k, "a b\nc") for k in range(40)]
    agree(docs(spark, rows).selectExpr("*", "1 AS n", "2 AS form", "3 AS part", "4 AS k1"), rows)


def test_empty_table(spark):
    assert infill.infill(docs(spark, [])).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = [(1, "the same text, twice")] * 50 + [(1, "an other one"), (None, "no id here"), (None, "no id here"), (None, None), (2, "the same text, twice")]
    agree(docs(spark, rows), rows)


@given(st.lists(st.text(st.sampled_from("aZ <>PSM\n1é😀\r\x00"), max_size=200), max_size=12))
@settings(max_examples=10, deadline=None)
def test_any_text(spark, texts):
    rows = list(enumerate(texts, 7))
    agree(docs(spark, rows), rows)


def test_query_and_sql(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = infill.op11_infill(spark, "/root/testdata/sf0.001").collect()
    want = [expected(r.doc_id, r.text) for r in rows]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by_id = {w[0]: (*w[:5], sha(w[5]), sha(r.text or "")) for w, r in zip(want, rows, strict=True)}
    assert {r.doc_id: tuple(r) for r in out} == by_id
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert {r[0]: tuple(r) for r in duckdb.sql(infill.OP11_SQL).fetchall()} == by_id
    assert {r.form for r in out} == {"plain", "psm", "spm"}
