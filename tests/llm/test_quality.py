import re
from collections import Counter

import numpy as np
from helpers import docs, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_odd_texts(spark):
    texts = odd_texts() + ["a b c d e a b c d e x", "l1\nl1\n\n \nl1 \nl2|#"]
    rows = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        assert tuple(rows[k][c] for c in quality.BASE) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert rows[k].base_failed == failed
        assert not (failed and rows[k].kept)


def test_empty_table(spark):
    assert quality.judge(docs(spark, [])).count() == 0


@given(st.lists(st.sampled_from("ab"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_repeated_words(words):
    assert quality.repeated_words([w.encode() for w in words]) == plain(" ".join(words))[4]


def test_estimate_finds_known_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(40000) < 0.8
    acc = [0.95, 0.9, 0.8, 0.85]
    code = np.zeros(len(good), int)
    for a in acc:
        right = rng.random(len(good)) < a
        vote = np.where(right == good, 1, 2)
        vote[rng.random(len(good)) < 0.3] = 0
        code = code * 3 + vote
    post, share, got = quality.estimate(dict(Counter(code.tolist())), rules=4)
    assert abs(share - 0.8) < 0.02
    assert np.abs(got - np.array(acc)[:, None]).max() < 0.05
    assert np.mean([(post[c] >= 0.5) == g for c, g in zip(code.tolist(), good)]) > 0.93


def test_accuracies_are_estimates_and_not_bounds(spark):
    """Over the votes of a table: one more document of a rule's votes moves its accuracy, and few are all but sure."""
    own = {r.pattern: r.n for r in quality.votes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("pattern").agg({"*": "count"}).toDF("pattern", "n").collect()}
    post, good, acc = quality.estimate(own)
    weights = np.array([own[p] for p in sorted(own)]), np.array([post[p] for p in sorted(own)])
    v = np.array([quality.digits(p) for p in sorted(own)])
    for c, w in enumerate((weights[0] * weights[1], weights[0] * (1 - weights[1]))):
        for k in range(8):
            assert abs(acc[k, c] - (w @ (v[:, k] == c + 1) + 0.8) / (w @ (v[:, k] > 0) + 1)) < 1e-3
    assert 0.5 < good < 1 and (acc[:, 1] < 0.5).any()  # a rule for one kind of bad document is wrong on most others
    told = quality.coverage(own, post)
    assert told.shape == (8, 2) and (told > 0).all() and (told < 1).all()


def test_keeps_good_and_drops_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    out = quality.op6_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in out if r.label == q] for q in (1, 0))
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.3


def test_repeated_rows_null_ids_and_clashing_names(spark):
    text = "one two three four five six seven eight nine ten eleven"
    df = docs(spark, [(1, text), (1, text), (None, text), (2, None)]).selectExpr("*", "1 AS pattern", "2 AS quality", "3 AS n_words", "4 AS kept")
    rows = quality.judge(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 11, True), (1, 11, True), (1, 11, True), (2, 0, False)]
    assert len({r.quality for r in rows if r.n_words}) == 1


def test_posterior_against_sums_over_both_classes(spark):
    """The posterior of each pattern by Bayes' rule from the accuracies that were estimated."""
    own = {r.pattern: r.n for r in quality.votes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("pattern").agg({"*": "count"}).toDF("pattern", "n").collect()}
    post, good, acc = quality.estimate(own)
    for p, q in post.items():
        both = [good, 1 - good]
        for k, v in enumerate(quality.digits(p)):
            for c in (0, 1):
                both[c] *= 1 if v == 0 else acc[k, c] if v == c + 1 else 1 - acc[k, c]
        assert abs(q - both[0] / sum(both)) < 1e-3
