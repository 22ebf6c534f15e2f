import random

from tidemark.llm.common import Scratch, components, numbered, split_join


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5, 5), (3000, 3001), (3001, 3000)]
    edges += [(rng.randrange(4000, 4200), rng.randrange(4000, 4200)) for _ in range(150)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_numbers_are_gapless(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(500)]
    out = numbered(spark.createDataFrame(rows, "g int, k long"), Scratch(spark, "t"), ["g"], ["k"], "n", buckets=8).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append(r.n)
    assert len(out) == 500 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_split_join_keeps_hot_and_cold_keys(spark):
    from pyspark.sql import functions as F

    rows = [("hot", k) for k in range(3000)] + [(f"k{k % 900}", k) for k in range(1800)] + [(None, 1)]
    left = spark.createDataFrame(rows, "key string, n long")
    scratch = Scratch(spark, "t")
    right = scratch.save(left.where("key IS NOT NULL AND key <> 'k7'").groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("least")))
    semi = split_join(left, right, "key", "left_semi", parts=10).collect()
    assert sorted(map(tuple, semi)) == sorted(r for r in rows if r[0] not in (None, "k7"))
    both = split_join(left, right, "key", "inner", parts=10)
    assert both.count() == len(semi) and {r.least for r in both.where("key = 'hot'").collect()} == {0}
    assert split_join(left, right.where("false"), "key", "inner").count() == 0


def test_scratch_needs_a_shared_folder(spark):
    import pytest

    from tidemark.sources import scratch

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())
