from helpers import docs, odd_texts

import corpus_pipeline
from tidemark.llm import near_copies

SF = "/root/testdata/sf0.001"


def expected(pairs):
    """The smallest doc_id of each component of all pairs with a five-word Jaccard similarity of 0.8 or more."""
    pairs = sorted(pairs)
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    lab = list(range(len(pairs)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if lab[i] != lab[j] and (x == y or 10 * len(x & y) >= 8 * len(x | y)):
                a, b = sorted((lab[i], lab[j]))
                lab = [a if v == b else v for v in lab]
    return {pairs[k][0] for k in lab}


def kept(df):
    return {r.doc_id for r in corpus_pipeline.without_near_copies(None, df, "").collect()}


def near(n, every, tag):
    """Texts that differ from the first in every ``every``-th word at most."""
    base = [f"{tag}{k}" for k in range(n)]
    return [" ".join(base), *[" ".join([*base[:at], f"new{at}", *base[at + 1 :]]) for at in range(0, n, every)]]


def test_similarity_of_four_fifths(spark):
    edge = [f"e{k}" for k in range(49)]  # 45 shingles; five others of 45: 40 / 50
    texts = [" ".join(edge), " ".join([*edge[:20], "x", *edge[21:]]), " ".join([*edge[:20], "x", *edge[21:30], "y", *edge[31:]])]
    short = [f"s{k}" for k in range(48)]  # 39 / 49
    texts += [" ".join(short), " ".join([*short[:20], "x", *short[21:]]), *odd_texts() * 2]
    pairs = list(enumerate(texts))
    want = expected(pairs)
    assert {0, 3, 4} <= want and 1 not in want and kept(docs(spark, pairs)) == want


def test_crowded_keys(spark):
    """More texts under a key than FEW: a chain of links and a cloud."""
    texts = near(200, 2, "a") + near(60, 5, "b")
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k : k + 120]) for k in range(0, 80, 2)]
    pairs = list(enumerate(texts))
    want = expected(pairs)
    assert len(want) < 5 and kept(docs(spark, pairs)) == want


def test_tasks_of_a_crowded_key(spark, monkeypatch):
    """Several clouds under one key, in blocks: every pair of different components with an asking set meets once or more."""
    monkeypatch.setattr(near_copies, "CHUNK", 7)
    rows = [(1, k, root) for root, n in ((100, 40), (200, 12), (300, 9)) for k in range(root, root + n)] + [(2, k, 5) for k in range(50)]
    made = near_copies.dealt(spark.createDataFrame(rows, "key long, set long, root long")).collect()
    tasks = {}
    for r in made:
        tasks.setdefault((r.key, r.i, r.j), []).append(r)
    assert all(k[0] == 1 for k in tasks) and max(map(len, tasks.values())) <= 40
    met = {(a.set, b.set) for own in tasks.values() for a in own for b in own if a.asks and a.root != b.root}
    root = {s: r for k, s, r in rows if k == 1}
    assert {(a, b) for a in root for b in root if root[a] != root[b] and root[a] != 100} <= met


def test_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        df = spark.read.parquet(f"{sf}/documents.parquet")
        assert kept(df) == expected([(r.doc_id, r.text) for r in df.collect()])


def test_whole_rows_and_empty_table(spark):
    df = docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, "c")])
    assert sorted((r.doc_id or 0, r.text) for r in near_copies.representatives(df).collect()) == [(0, "c"), (1, "a b")]
    assert near_copies.representatives(df.where("false")).count() == 0


def test_fingerprints_give_candidates(spark, tmp_path):
    """Without minimum hashes, texts within four bits meet through the Golay keys; what isn't similar is left out."""
    base = [f"w{k}" for k in range(900)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(base[1:]), " ".join(f"z{k}" for k in range(60)), ""]
    df = docs(spark, texts)
    own = near_copies.sketches(df).selectExpr("set", "fp", "CAST(array() AS array<bigint>) AS keys", "__row_key AS one", "doc_id").cache()
    fps = {r.doc_id: r.fp for r in own.collect()}
    assert len({fps[0], fps[1], fps[2]}) > 1 and fps[4] == 0
    roots = near_copies.rooted(df, own.drop("doc_id"), near_copies.Scratch(spark, "test"))
    got = {r.doc_id: r.root for r in own.join(roots, own.set == roots.node).collect()}
    assert set(got) == {0, 1, 2} and len(set(got.values())) == 1


def test_few_tables_are_files(spark, monkeypatch):
    """Only the sets, the components' rounds and the rows to keep are written to the shared folder, and nothing stays held."""
    saved, save = [], near_copies.Scratch.save
    monkeypatch.setattr(near_copies.Scratch, "save", lambda self, df: saved.append(sorted(df.columns)) or save(self, df))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    pairs = list(enumerate([*near(200, 2, "a"), *odd_texts() * 2]))
    assert kept(docs(spark, pairs)) == expected(pairs)
    others = [c for c in saved if c != ["u", "v"]]  # u, v: the components' rounds
    assert others == [sorted(["set", "fp", "keys", "one", "least"]), [near_copies.KEY]]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
