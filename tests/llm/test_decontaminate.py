import random

import numpy as np
from helpers import docs, odd_texts

from tidemark.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_common():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert dc.common(dc.masks_of(np.array(a)), len(a), b) == plain_lcs(a, b)


def every_pair(texts, item_texts):
    """Without the latent space: every window against every item."""
    items = dc.read_items([(k, t, None) for k, t in enumerate(item_texts)])
    words = {d: np.array([items.vocabulary.get(w, -1) for w in dc.WORD.findall((t or "").encode().lower())], int) for d, t in texts.items()}
    rows = dc.windows([w for w in words.values() if len(w) and w.max() >= 0])
    df = np.zeros(len(items.vocabulary), int)
    for r in rows:
        df[np.unique(r[r >= 0])] += 1
    out = set()
    for d, w in words.items():
        for i, own in zip(items.ids, items.words):
            answer = dc.rarer_half(own, df)
            if any(dc.judged(w, s, own, dc.masks_of(own), answer, dc.SHARE) for s in range(0, max(1, len(w)), dc.STEP)):
                out.add((d, i))
    return out


def test_recall_against_every_pair(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in dc.op1_decontaminate(spark, d).collect()}
    ids = sorted(items)
    want = {(a, ids[b]) for a, b in every_pair(texts, [items[i] for i in ids])}
    whole = {(a, i) for a, t in texts.items() for i, x in items.items() if x in t}
    assert whole <= got <= want
    assert len(got) >= 0.95 * len(want)


def test_paraphrases_are_found_and_clean_texts_are_not(spark):
    d = "/root/testdata/sf0.01"
    rng = random.Random(7)
    base = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").limit(400).collect()]
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    rows = items.collect()
    texts, want = list(base), {}
    for r in rows:
        w = r.text.split()
        out = []
        for x in w:
            p = rng.random()
            if p < 0.08:
                continue
            out.append("replaced" if p < 0.16 else x)
        if len(w) > 5:
            out[2], out[3] = out[3], out[2]
        want[len(texts)] = r.item_id
        texts.append(base[rng.randrange(400)][:300] + " " + " ".join(out) + " " + base[rng.randrange(400)][:300])
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, texts), items).collect()}
    assert sum((k, i) in got for k, i in want.items()) >= 0.95 * len(want)
    clean = {k for k in range(400) if not any(r.text in base[k] for r in rows)}
    assert len({k for k, _ in got} & clean) <= 2


def test_odd_texts_empty_tables_and_clashing_names(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (1, None), (2, ""), (3, "a b"), (4, "é ü ß ö ä ñ words")], ITEMS)
    texts = [*odd_texts(), "x one two three four five six seven y", "É ü ß ö ä ñ words"]
    df = docs(spark, texts).selectExpr("*", "1 AS words", "2 AS item_id", "3 AS __row_key")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(df, items).collect()}
    assert {(len(texts) - 2, 1), (len(texts) - 1, 4), (4, 3), (5, 3)} == got  # "a b" stands in sequence
    assert dc.leaks(df, items.where("false")).count() == 0
    assert dc.leaks(docs(spark, []), items).count() == 0
    left = {r.doc_id for r in dc.decontaminated(docs(spark, texts), items).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_answers(spark):
    items = spark.createDataFrame([(1, "which river runs through the city of old kings", "amber")], "item_id long, text string, answer string")
    q = "which river runs through the city of old kings"
    got = {r.doc_id for r in dc.leaks(docs(spark, [q + " amber", q + " none", "nothing here at all"]), items).collect()}
    assert got == {0}


def test_short_items_are_whole_sequences(spark):
    items = spark.createDataFrame([(1, "Stop"), (2, "red green"), (3, "one two three four"), (4, "?!")], ITEMS)
    texts = ["now stop here", "stopped", "red blue green", "a RED, green b", "one two three five four", "x one two\nthree four", "stop stop"]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, texts), items).collect()}
    assert got == {(0, 1), (6, 1), (3, 2), (5, 3)}


def test_pairs_are_the_same_in_any_number_of_blocks(spark):
    d = "/root/testdata/sf0.01"
    df, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, dc.leaks(df, items, block_bytes=n).drop("__row_key").collect())) for n in (1 << 24, 4000))
    assert len(dc.read_items([(r.item_id, r.text, None) for r in items.collect()]).blocks(4000)) >= 3
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) > 10
    assert np.allclose([r[2:] for r in one], [r[2:] for r in many], atol=1e-5)


def test_space_against_an_exact_decomposition(spark):
    """The sketch's singular values and cosines against numpy's over all passages."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = dc.read_items([(r.item_id, r.text, None) for r in spark.read.parquet(f"{d}/benchmark.parquet").limit(12).collect()])
    n, kind = len(items.vocabulary), "<i2"
    keyed = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "doc_id long, __row_key long, text string")
    encoded = dc.encode(keyed, items)
    df, passages = dc.frequencies(encoded, kind, n)
    weight = dc.weigh(items, df, passages)
    words = [np.array([items.vocabulary.get(w, -1) for w in dc.WORD.findall((t or "").encode().lower())], int) for t in texts.values()]
    rows = dc.windows([w for w in words if len(w) and w.max() >= 0])
    a = np.zeros((len(rows), n))
    for k, r in enumerate(rows):
        np.add.at(a[k], r[r >= 0], weight[r[r >= 0]])
    a /= np.maximum(np.linalg.norm(a, axis=1), 1e-12)[:, None]
    assert passages == len(rows) and (df == np.array([(rows == w).any(axis=1).sum() for w in range(n)])).all()
    b = dc.sketch(encoded, kind, weight, 200)
    g = dc.test_matrix(n, 200)
    vectors = dc.space(b, weight)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > s[0] * 1e-4
    exact = weight[:, None] * (vt[keep] / s[keep][:, None]).T
    q = [np.array(w) for w in items.words]
    mine, best = (dc.unit(np.stack([v[w].sum(axis=0) for w in q])) for v in (vectors, exact))
    assert g.shape == (n, 200) and np.abs(mine @ mine.T - best @ best.T).max() < 0.15


def test_reordered_paraphrases(spark):
    """Half of the words moved: what the common subsequence allows is found, what it doesn't isn't by design."""
    d = "/root/testdata/sf0.01"
    rng = random.Random(9)
    base = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").limit(200).collect()]
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    texts, want = list(base), {}
    for r in items.collect():
        w = r.text.split()
        cut = len(w) // 4
        moved = w[cut : len(w) - cut] + w[:cut][::-1] + w[len(w) - cut :]  # the second quarter block goes behind, backwards
        want[len(texts)] = r.item_id
        texts.append(base[rng.randrange(200)][:300] + " " + " ".join(moved) + " " + base[rng.randrange(200)][:300])
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(spark, texts), items).collect()}
    assert sum((k, i) in got for k, i in want.items()) >= 0.9 * len(want)


def test_repeated_rows_and_null_ids(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], ITEMS)
    text = "x one two three four five six seven"
    df = docs(spark, [(1, text), (1, text), (None, text), (2, "other")])
    assert sorted((r.doc_id or 0) for r in dc.leaks(df, items).collect()) == [0, 1]
    assert [r.doc_id for r in dc.decontaminated(df.selectExpr("*", "9 AS __row_key"), items).collect()] == [2]
    assert dc.decontaminated(df.selectExpr("*", "9 AS __row_key"), items).first()["__row_key"] == 9


def test_words_and_sums_of_rows_against_plain_ones():
    text = bytes(range(256)) * 2 + "Straße ÀÉ x-y_z 10^3\x1c\x1fEnd\u2003wide".encode()
    assert dc.words_of(text) == dc.WORD.findall(text.lower()) and dc.words_of(b" \n.") == []
    rng = np.random.default_rng(3)
    vectors, flat = rng.standard_normal((20, 5), np.float32), rng.integers(-1, 20, 96).astype("<i2")
    want = [sum((vectors[w] for w in row if w >= 0), np.zeros(5)) for row in flat.reshape(-1, 32)]
    assert np.allclose(dc.sums(flat, 32, dc.padded(vectors)), want, atol=1e-5)


def test_only_words_of_the_item_go_to_the_common_subsequence():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    item, words = np.arange(6, dtype="<i2"), np.array([90, -1, 80] * 5 + [0, 1, 70, 2, 4, 5] + [60, -1] * 6, "<i2")
    held = dc.Held([item, item + 50], 100)
    masks = Counted(dc.masks_of(item))
    got = dc.judged(words, 0, item, masks, {1, 70}, 0.6, lambda w: held.one(0, w))
    assert got == dc.judged(words, 0, item, dc.masks_of(item), {1, 70}, 0.6) == (5, 1.0) and masks.asked == 5
