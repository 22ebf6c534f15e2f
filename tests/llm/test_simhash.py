import re

import numpy as np
import pytest
import xxhash
from helpers import docs, odd_texts

from tidemark.llm import simhash


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps):
    lab = np.arange(len(fps))
    for i in range(len(fps)):
        hit = np.bitwise_count(fps ^ fps[i]) <= 4
        m = np.isin(lab, lab[hit])
        lab[m] = lab[m].min()
    return lab


def expected(pairs):
    pairs = sorted(pairs)
    fps = np.array([plain(t) for _, t in pairs], np.uint64)
    lab = closure(fps)
    return {d: (f"{int(f):016x}", pairs[lab[k]][0]) for k, ((d, _), f) in enumerate(zip(pairs, fps))}


def result(df):
    return {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect()}


def test_odd_texts(spark):
    pairs = list(enumerate(odd_texts() * 3))
    assert result(simhash.near_duplicates(docs(spark, pairs))) == expected(pairs)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_clashing_names(spark):
    df = docs(spark, ["a b", "c"]).selectExpr("*", "1 AS fp", "2 AS key", "3 AS component_id")
    assert {r.doc_id for r in simhash.near_duplicates(df).collect()} == {0, 1}


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == expected([tuple(r) for r in rows])


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_a_dense_cloud(spark, seed):
    """Chains and clouds of fingerprints a few bits apart, as a group of near copies gives them."""
    rng = np.random.default_rng(seed)
    fps = [*rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for centre in (0, int(fps[0]), int(fps[1])):
        x = np.uint64(centre)
        for _ in range(150):
            y = np.uint64(centre)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= np.uint64(1) << np.uint64(b)
            for b in rng.choice(64, 4, replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            fps += [y, x]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    edges = simhash.links(df).collect()
    at = {int(f): k for k, f in enumerate(fps.view(np.int64))}
    lab = np.arange(len(fps))
    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        la, lb = lab[at[a]], lab[at[b]]
        lab[lab == max(la, lb)] = min(la, lb)
    want = closure(fps)
    assert len({*zip(lab, want)}) == len({*lab}) == len({*want})
