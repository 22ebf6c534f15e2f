import hashlib
import math
import random
import re

from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if ok(k, m[0])]


def got(row):
    return [(k, x.s, x.e) for k in pii.KINDS for x in row[k]]


def test_odd_texts(spark):
    texts = odd_texts() + ["a@b.c_d@e.f@g.h", "é x@y.zz, +1 (555) 010-9999 1.2.3.4.5 300.1.1.1 001.2.3.4", "4111 1111 1111 1111-4111", "9" * 60000, "1 " * 12000, "a" * 200000, "a.b@" * 3000, "+1 2" + "-" * 5000]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert got(rows[k]) == plain(t), t[:50]


@given(st.lists(st.text(st.sampled_from("a1@.-+ (_é0"), max_size=40), min_size=20, max_size=60))
@settings(max_examples=4, deadline=None)
def test_any_text(spark, texts):
    rows = {r.doc_id: r for r in pii.base_spans(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert got(rows[k]) == plain(t)


def test_empty_table_and_repeated_rows(spark):
    assert pii.find(docs(spark, [])).count() == 0
    rows = pii.find(docs(spark, [(1, "a@b.cc"), (1, "a@b.cc"), (None, "x")]).selectExpr("*", "1 AS tokens", "2 AS extra")).collect()
    assert sorted(got(r) for r in rows) == [[], [("email", 0, 6)], [("email", 0, 6)]]


def extras(texts, rows):
    return {(k, texts[k][x.s : x.e], x.kind) for k in rows for x in rows[k].extra}


def test_contexts_find_what_no_pattern_does(spark):
    seeds = [f"words here, call me at +1 (555) 010-{1000 + k} today" for k in range(8)]
    mails = [f"then write to us: u{k}@mail.org now" for k in range(8)]
    texts = [*seeds, *mails, "please call me at (+1/555/010/7777), now", "or write to us: someone@localhost now", "the year is 20240101 and so on", "it is 1234567 of them", "and call me at 12 sharp"]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    assert all(len(rows[k].phone) == 1 for k in range(8)) and all(len(rows[k].email) == 1 for k in range(8, 16))
    assert extras(texts, rows) == {(16, "+1/555/010/7777", "context"), (17, "someone@localhost", "context")}
    assert not any(x.s < y.e and y.s < x.e for r in rows.values() for x in r.extra for k in pii.KINDS for y in r[k])


def test_keyed_secrets_teach_their_contexts(spark):
    rng = random.Random(3)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 3)) + "a1b"[:3]
    long = [value(40) for _ in range(8)]
    texts = [f'set token = "{v}" here' for v in long] + [f"the session: {v} is open" for v in long]  # seeds show what "session:" is
    texts += ["the session: 77ab19cd0e is open", "token=9f8e7d6c5b done", 'x TOKEN = "' + long[0].upper() + '"!! y', f"alone {long[1]} again", "version: 4.0 and session 12", "page: 12345678 of them"]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    secrets = {(k, v, "secret") for k, v in enumerate(long)} | {(18, long[0].upper(), "secret")}
    known = {(8 + k, v, "context") for k, v in enumerate(long)} | {(19, long[1], "context")}
    assert extras(texts, rows) == secrets | known | {(16, "77ab19cd0e", "context"), (17, "9f8e7d6c5b", "context")}


def plain_scores(edges):
    """(pattern, instance) to (seed, told), by loops: trusted patterns and instances with their scores."""
    seeds = {i for (_, i), (s, _) in edges.items() if s}
    able = seeds | {i for (_, i), (_, t) in edges.items() if t}
    score = {i: float(i in seeds) for _, i in edges}
    while True:
        trust = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p]
            support, n = sum(score[i] for i in own), len(able.intersection(own))
            t = support / (support + len(own) - n + pii.DOUBT)
            if len(seeds.intersection(own)) >= pii.LEAST_SEEDS and t >= pii.TRUST and support / n * math.log2(max(support, 1)) >= pii.LEAST_WORTH:
                trust[p] = t
        new = {}
        for i in score:
            doubt = 1.0
            for p, j in edges:
                if j == i and p in trust:
                    doubt *= 1 - trust[p]
            new[i] = 1.0 if i in seeds else 1 - doubt
        rise = max(new[i] - score[i] for i in score)
        score = new
        if rise <= pii.SETTLED:
            return trust, score


def test_scores_against_loops(spark):
    rng = random.Random(8)
    told = {i: rng.random() < 0.7 for i in range(150)}
    seeds = {i for i in told if rng.random() < 0.4}
    edges = {(f"p{p}", f"i{i}"): (i in seeds, told[i]) for i in told for p in rng.sample(range(12) if told[i] else range(6, 30), rng.randrange(1, 4))}
    df = spark.createDataFrame([(p, i, s, t) for (p, i), (s, t) in edges.items()], "pattern string, instance string, seed boolean, told boolean")
    trusted, scores = pii.scored(df, pii.Scratch(spark, "t"))
    trust, score = plain_scores(edges)
    assert 0 < len(trust) < 30
    assert {r.pattern: round(r.trust, 6) for r in trusted.collect()} == {p: round(t, 6) for p, t in trust.items()}
    assert {r.instance: round(r.score, 6) for r in scores.collect()} == {i: round(t, 6) for i, t in score.items()}


def test_unknown_values_are_no_counterexamples(spark):
    """One pattern of 100 values: the known half teaches it, three of a thousand don't, and small numbers speak against it."""
    rows = [("half", f"h{k}", k < 50, True) for k in range(100)] + [("few", f"f{k}", k < 3, True) for k in range(1000)] + [("mixed", f"m{k}", k < 50, k < 75) for k in range(100)]
    trusted, _ = pii.scored(spark.createDataFrame(rows, "pattern string, instance string, seed boolean, told boolean"), pii.Scratch(spark, "t"))
    assert {r.pattern for r in trusted.collect()} == {"half"}


def test_failed_checks_speak_against_a_pattern(spark):
    """Numbers of a card's form after a common word: those that fail the check are no cards, whatever stands before them."""
    cards = ["4111111111111111", "5500005555555559", "6011000000000004", "3530111333300000", "4012888888881881", "5105105105105100"]
    texts = [f"pay by the {c} now" for c in cards] + [f"pay by the {c[:-1]}{(int(c[-1]) + 1) % 10} now" for c in cards]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    assert [len(rows[k].card) for k in range(12)] == [1] * 6 + [0] * 6
    assert extras(texts, rows) == set()


def plain_instances(text):
    """By loops over all base spans: the values of a text's instances and whether they are seeds."""
    base, out = sorted((a, b) for _, a, b in plain(text)), []
    for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text):
        a, b = m.span()
        if any(x < a < y for x, y in base):
            continue
        own = [x for x in base if a <= x[0] < b]
        out.append((*own[0], True) if own else (a, b, False))
    return sorted(out)


@given(st.lists(st.text(st.sampled_from("a1@.-+ (4"), max_size=50), min_size=10, max_size=40))
@settings(max_examples=4, deadline=None)
def test_instances_against_loops(spark, texts):
    df = docs(spark, [*texts, "1.2.3.4,u@a.bc u@a.bc;1.2.3.4 +1 23 456 7890 5"])
    keys = {r["__key"]: r.doc_id for r in pii.base_spans(df).collect()}
    got = {}
    for r in pii.instances(pii.base_spans(df)).collect():
        got.setdefault(keys[r["__key"]], []).append((r.s, r.e, r.seed))
    for k, t in enumerate(texts):
        assert [x[:1] + x[2:] for x in sorted(got.get(k, []))] == [x[:1] + x[2:] for x in plain_instances(t)], t


def test_planted_secrets(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    planted = {(k, *m.span(1)) for k, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]+)"', t)}
    found = {(r.doc_id, x.s, x.e) for r in pii.find(df).collect() for x in r.extra}
    assert len(planted) > 100 and len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.05 * len(planted)


def test_hidden_seeds_come_back_from_contexts(spark):
    """Half of all seed values, by their hash, are like any other token: their contexts find the secrets among them."""
    scratch = pii.Scratch(spark, "t")
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = scratch.save(pii.base_spans(df))
    shown = F.pmod(F.xxhash64("instance"), F.lit(2)) == 0
    secrets = pii.described(pii.instances(found)).where("secret").select("__key", "s", "e", shown.alias("shown")).collect()
    hidden = {(r["__key"], r.s, r.e) for r in secrets if not r.shown}
    assert 50 < len(hidden) < len(secrets) - 50
    back = {(r["__key"], x.s, x.e) for r in pii.discover(found, scratch, shown).collect() for x in r.extra if x.kind == "context"}
    assert len(back & hidden) >= 0.9 * len(hidden)
    base = {(r["__key"], x.s, x.e) for r in found.select("__key", *pii.KINDS).collect() for k in pii.KINDS for x in r[k]}
    assert len(back - hidden - base) <= 0.05 * len(hidden)


def test_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
