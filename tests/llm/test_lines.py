import duckdb
import pytest
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lines

LONG = {c: " ".join(f"{c}{i}" for i in range(n)) for c, n in zip("ABCDef", (60, 50, 30, 25, 2, 1), strict=True)}


def maximal(texts, min_lines=3, min_words=50):
    """Deletes the lines of runs, of that many lines or words, that stand at an earlier place too. Where the first place
    is in the same text, its lines stay."""
    body = [(d, k, tuple(x.encode().split())) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.encode().split()]
    first, gone, own, kept = {}, set(), set(), set()
    for b in range(len(body)):
        for n in range(1, min_lines + 1):
            run = body[b : b + n]
            if len(run) < n or run[-1][0] != run[0][0] or (n < min_lines and sum(len(x[2]) for x in run) < min_words):
                continue
            a = first.setdefault(tuple(x[2] for x in run), b)
            places = {x[:2] for x in run}
            if a < b and body[a][0] != body[b][0]:
                gone |= places
            elif a < b:
                own |= places
                kept |= {x[:2] for x in body[a : a + n]}
    dead = gone | (own - kept)
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in dead) for d, t in enumerate(texts)]


def cleaned(df, n, **how):
    got = {r.doc_id: r.text for r in lines.clean(df, **how).collect()}
    return [got[k] for k in range(n)]


def test_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [*odd_texts(), "a\nb\nc", "x\na \n\n b\nc\ny", "a\nb", f"p\n{long}", f"{long}\nq", "a\na\na\na\na", "\n".join(f"v{k}" for k in range(30000))]
    assert cleaned(docs(spark, texts), len(texts)) == [*maximal(texts[:-1]), texts[-1]]


def test_the_end_of_a_run_goes(spark):
    a, c, e, f = (LONG[x] for x in "ACef")
    texts = [f"{a}\n{e}\n{f}", f"{a}\n{e}\n{f}", f"p\n{a}\n{e}\nq\nr", f"{c}\n{c}\n{e}", f"{c}\n{c}\n{e}\nz", f"s\n{a}\n{f}"]
    assert cleaned(docs(spark, texts), 6) == maximal(texts) == [texts[0], "", "p\nq\nr", texts[3], "z", f"s\n{f}"]


def test_the_first_copy_is_kept_whole(spark):
    texts = ["\n".join(["x x"] * 4), "\n".join("ab" * 4), "\n".join(["p", *"cde", "q", *"cde"]), "\n".join("fgf" * 3), "\n".join("ab" * 3)]
    want = ["x x\nx x\nx x", "a\nb\na\nb", "p\nc\nd\ne\nq", "\n".join("fgffgf"[:5]), ""]
    got = cleaned(docs(spark, texts), len(texts))
    assert got == maximal(texts) and got[:3] == want[:3] and got[4] == ""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert [r[0] for r in con.sql(f"SELECT text FROM ({lines.OP9_SQL}) ORDER BY doc_id").fetchall()] == got


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 12), st.integers(0, 2)), min_size=1, max_size=5))
@settings(max_examples=8, deadline=None)
def test_periodic_lines(spark, parts):
    """Lines that recur with a period, in one text and over several."""
    texts = ["\n".join([*(f"l{(k + shift) % period}" for k in range(n)), f"end {period} {n}"]) for period, n, shift in parts]
    assert cleaned(docs(spark, texts).coalesce(1), len(texts)) == maximal(texts)


def test_equal_rows_count_once(spark):
    rows = [r.text for r in lines.clean(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "z"), (None, "x\ny\nz"), (2, "x\ny\nz\nw")])).collect()]
    assert sorted(rows) == ["a\nb\nc", "a\nb\nc", "w", "x\ny\nz", "z"]  # a null doc_id stands first


def test_empty_table_and_clashing_names(spark):
    assert lines.clean(docs(spark, [])).count() == 0
    df = docs(spark, ["a\nb\nc\nd"]).selectExpr("*", "1 AS fp", "2 AS N_removed", "3 AS words", "4 AS __row", "5 AS __runs", "6 AS runs", "7 AS count", "8 AS digest")
    row = lines.clean(df).first()
    assert (row.text, row.fp, row["__row"], row["__runs"], row.runs, row["count"], row.digest, row.n_removed) == ("a\nb\nc\nd", 1, 4, 5, 6, 7, 8, 0)


def test_a_line_that_all_hold(spark):
    """A hot fingerprint and a hot run, and repeats beside them."""
    texts = [f"own {k}\nall\nhold\nthis\nmore {k}\npair {k // 2} a\npair {k // 2} b\npair {k // 2} c" for k in range(60)]
    assert cleaned(docs(spark, texts), 60) == maximal(texts)


def test_fewer_rows_are_dealt_than_lines(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "doc_id AS row", "text")
    made = lines.hashed(df, 3, 50).collect()
    assert sum(len(r.selected) for r in made) < 0.7 * sum(len(r.words) for r in made)


@given(st.lists(st.lists(st.sampled_from([*LONG.values()]), max_size=9), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_any_runs(spark, texts):
    texts = ["\n".join(t) for t in texts]
    assert cleaned(docs(spark, texts).coalesce(1), len(texts)) == maximal(texts)


@pytest.mark.parametrize("size", [(2, 4), (5, 40), (1, 100)])
@given(st.lists(st.lists(st.sampled_from(["a", "b b", "c c c", LONG["C"]]), max_size=14), min_size=1, max_size=5))
@settings(max_examples=6, deadline=None)
def test_other_windows(spark, size, texts):
    texts = ["\n".join(t) for t in texts]
    assert cleaned(docs(spark, texts).coalesce(1), len(texts), min_lines=size[0], min_words=size[1]) == maximal(texts, *size)


def test_sql_and_all_pairs_agree(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = dict((r[0], r[1]) for r in con.sql(f"SELECT doc_id, text FROM ({lines.OP9_SQL})").fetchall())
    got = {r.doc_id: r.text for r in lines.op9_line_dedup(spark, d).collect()}
    order = sorted(got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert got == want and [got[k] for k in order] == maximal([texts[k] for k in order])
