import zlib

from helpers import docs, odd_texts
from pyspark.sql import functions as F

from tidemark.llm import sharding


def sound(rows, texts, shards):
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 16 and r.text_crc32 == zlib.crc32(b)
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_texts(spark):
    texts = odd_texts()
    sound(sharding.shard(docs(spark, texts), 5).collect(), dict(enumerate(texts)), 5)


def test_empty_table(spark):
    assert sharding.shard(docs(spark, []), 4).count() == 0


def test_one_value_everywhere(spark):
    """Equal texts, lang and source: the bytes still come out even."""
    df = docs(spark, ["same text"] * 400).selectExpr("doc_id", "text", "lang", "source", "1 AS shard", "2 AS tie", "3 AS node")
    rows = sharding.shard(df, 8).collect()
    counts = [sum(r.shard == k for r in rows) for k in range(8)]
    assert sum(counts) == 400 and max(counts) - min(counts) <= 8


def test_nulls_in_metadata_and_target(spark):
    df = docs(spark, [f"text {k}" * 30 for k in range(300)]).selectExpr("doc_id", "text", "if(doc_id % 3 = 0, null, lang) AS lang", "cast(null AS string) AS source")
    rows = sharding.shard(df, target_bytes=6000).collect()
    by = {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r.size
    total = sum(by.values())
    assert len(by) == -(-total // 6000)
    assert max(by.values()) < 1.25 * total / len(by)


def test_repeated_rows_and_null_ids_are_split(spark):
    df = docs(spark, [(7, "one text")] * 400 + [(None, "none")] * 400)
    rows = sharding.shard(df, 8).collect()
    by = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert len(rows) == 800 and max(by) - min(by) <= 0.05 * sum(by) / 8, by
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def plain_tree(rows, shards, first, spread, out):
    """Splits sorted lists: rows (dims, tie, size, index) to the shard of each index."""
    if shards == 1 or not rows:
        out.update({r[3]: first for r in rows})
        return
    reach = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(4)]
    dim = max(range(4), key=lambda d: (reach[d] / spread[d], -d))
    rows = sorted(rows, key=lambda r: (r[0][dim], r[1]))
    half = shards // 2
    goal = sum(r[2] for r in rows) * half / shards
    total = cut = 0
    for k, r in enumerate(rows):
        if total + r[2] >= goal:
            cut = k + 1 if abs(total + r[2] - goal) < abs(total - goal) else k
            break
        total += r[2]
    plain_tree(rows[:cut], half, first, spread, out)
    plain_tree(rows[cut:], shards - half, first + half, spread, out)


def test_tree_against_sorted_lists(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for shards in (7, 16):
        scratch = sharding.Scratch(spark, "t")
        made = scratch.save(sharding.prepare(df))
        rows = made.collect()
        leaf, level, n = sharding.grow(made, scratch, shards)
        assert n == len(rows)
        got = {r.row: level[r.node].first for r in leaf.collect()}
        spread = [max(max(r[c] for r in rows) - min(r[c] for r in rows), 1e-300) for c in sharding.DIMS]
        want = {}
        plain_tree([([r[c] for c in sharding.DIMS], r.tie, r.size, r.row) for r in rows], shards, 0, spread, want)
        assert got == want


def test_expressions_stay_of_one_size(spark):
    """Generated code must not grow with the nodes, or it falls back to interpretation."""
    rows = spark.range(9).selectExpr("id AS doc_id", "'a' AS text", "'en' AS lang", "'s' AS source")
    rows = sharding.prepare(rows).withColumn("node", F.lit(0))
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    sizes = []
    for n in (4, 400):
        level = [sharding.Node(k, 2, cut=(0.5, 0.5)) for k in range(n)]
        sizes.append(len(debug.codegenString(sharding.placed(rows, level)[0]._jdf.queryExecution().executedPlan())))
    assert 1000 < sizes[1] < 1.2 * sizes[0]


def test_table(spark):
    d = "/root/testdata/sf0.1"
    rows = sharding.op7_kd_shards(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sound(rows, texts, 40)
    by = [0] * 40
    for r in rows:
        by[r.shard] += r.size
    biggest = max(r.size for r in rows)
    assert max(by) - min(by) <= 2 * biggest, (min(by), max(by), biggest)
    assert max(by) <= 1.04 * sum(by) / 40
