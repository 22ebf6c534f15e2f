import math
from collections import Counter, defaultdict

import numpy as np
from helpers import docs, odd_texts

from tidemark.llm import language


def slow_model(counts, order):
    """Interpolated Kneser-Ney over dictionaries: p(symbol | up to order - 1 symbols before it in the word)."""
    grams = [Counter() for _ in range(order)]
    for word, c in counts.items():
        s = "\x02" + word + "\x03"
        for i in range(1, len(s)):
            for n in range(order):
                if i >= n:
                    grams[n][s[i - n : i + 1]] += c
    kn = []
    for n in range(order):
        count = Counter()
        if n < order - 1:
            for g in grams[n + 1]:
                count[g[1:]] += 1
        kn.append({g: (count[g] if n < order - 1 and not g.startswith("\x02") and count[g] else c) for g, c in grams[n].items()})
    tables = []
    for n in range(order):
        n1, n2 = (sum(1 for c in kn[n].values() if c == k) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = defaultdict(float), Counter()
        for g, c in kn[n].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables.append((d, kn[n], total, kinds))

    def p(before, ch):
        out = None
        for n in range(order):
            if n > len(before):
                break
            d, count, total, kinds = tables[n]
            ctx = before[len(before) - n :] if n else ""
            if ctx not in total:
                if out is None:
                    out = 1 / language.CHARACTERS
                continue
            lower = 1 / language.CHARACTERS if out is None else out
            out = max(count.get(ctx + ch, 0) - d, 0) / total[ctx] + min(max(d * kinds[ctx] / total[ctx], 1e-6), 1) * lower
        return out

    return lambda w: sum(math.log(p(("\x02" + w + "\x03")[:i], ("\x02" + w + "\x03")[i])) for i in range(1, len(w) + 2))


def test_model_equals_dictionaries():
    a = Counter({"the": 5, "then": 2, "hat": 1, "tea": 1, "a": 3})
    b = Counter({"der": 4, "die": 2, "das": 2, "hat": 2, "ü": 1})
    m = language.fit({"x": a, "y": b}, 4)
    words = ["the", "hat", "theta", "zzz", "a", "üb", "dader"]
    got, n = m.score(words)
    assert n.tolist() == [len(w) + 1 for w in words]
    for k, own in enumerate((a, b)):
        p = slow_model(own, 4)
        assert np.allclose(got[:, k], [p(w) for w in words], atol=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op4_language(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == df.count()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_texts_and_clashing_names(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learned_from(base)
    texts = [*odd_texts(), "123 456 !!", "кириллица здесь совсем другие буквы и слова " * 5]
    df = docs(spark, texts).withColumnRenamed("n_chars", "__k")
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert out[k].lang_pred == "und" and out[k].score == 0 and not out[k].accepted
        else:
            assert out[k].lang_pred in model.languages
    assert not out[len(texts) - 1].accepted


def test_a_language_left_out_is_rejected_and_mixed_texts_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 300")
    own = {lang: [r.text for r in df.where(f"lang = '{lang}'").limit(40).collect()] for lang in ("de", "en", "es", "fr")}
    for lang in own:
        model = language.learned_from(df.where(f"lang <> '{lang}'"), per_language=200)
        out = language.identify(docs(spark, own[lang]), model).collect()
        assert sum(not r.accepted for r in out) >= 0.9 * len(out), lang
    model = language.learned_from(df, per_language=200)
    mixed = [a[:300] + " " + b[:300] for a, b in zip(own["en"], own["es"])]
    assert all(r.accepted for r in language.identify(docs(spark, mixed), model).collect())
    short = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" From reha reenti oution', "a1b2c3"]
    assert all(r.lang_pred in model.languages for r in language.identify(docs(spark, short), model).collect())


def test_columns_so_named_and_repeated_rows(spark):
    model = language.learned_from(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df = docs(spark, [(1, "the and that"), (1, "the and that"), (None, "the"), (2, None)]).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS symbols", "4 AS accepted", "5 AS excess", "6 AS cross_entropy", "7 AS __0")
    rows = language.identify(df, model).collect()
    assert len(rows) == 4 and all(isinstance(r.lang_pred, str) and r["__0"] == 7 for r in rows)
    kept = language.known(df, model)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted((r.doc_id or 0, r.score, r.accepted) for r in kept.collect()) == [(0, 1, 4), (1, 1, 4), (1, 1, 4)]


def test_ties_go_to_the_first_name():
    m = language.fit({"b": Counter({"aa": 2}), "a": Counter({"aa": 2})}, 4)
    ll, _, n = language.Scorer(m)([b"aa"])
    assert m.languages == ["a", "b"] and n[0] == 3 and ll[0].argmax() == 0 and ll[0, 0] == ll[0, 1]


def test_nothing_to_learn(spark):
    model = language.learned_from(docs(spark, []))
    assert [r.lang_pred for r in language.identify(docs(spark, ["a b"]), model).collect()] == ["und"]
    assert language.identify(docs(spark, []), model).count() == 0
