"""Near copies by the Jaccard similarity of word shingles: those of five words, linked from 0.8.

Equal sets of shingles are made one first, so exact copies never meet each other. Candidates come by operator 3's method
first: each set has a SimHash fingerprint, and fingerprints within four bits meet through the keys of the Golay code.
Every candidate is verified by the exact similarity.

Two texts with a similarity of 0.8 differ in about ten bits of 64 (an angle of 27 degrees), where that method would need
over a thousand keys for each text to miss no more than one pair in a thousand. So minimum hashes add the candidates that
four bits don't reach: a set has 30 keys, each made of five; two sets of similarity 0.8 share no key with a probability
of (1 - 0.8^5)^30, 7 in a million, and more similar ones with less. A key with up to FEW sets gives its pairs, which are
made distinct and joined with the sets.

A key with more sets links each of them to its least one first, by the same join. That joins most of a cloud of near
copies, however large, without a task that reads it. Where a key's sets are in several components after that, those of
its largest component and the others are dealt out in blocks of ``CHUNK`` sets; each task compares a block of the others
with one of the largest component or of the others, between components only, and yields a spanning forest.

What is read more than once stays on the executors' disks (``Held``) or goes through a shuffle alone; only the sets, the
components and the rows to keep are files in the shared folder. A file there is a process that sets its permissions, where
that folder is a kernel's file system; for a moment such a process shares all memory of its executor.

Defined cases: null and wordless texts are equal to each other; a text of fewer words than a shingle is one shingle;
the others are as in operator 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, map_texts, split_join
from .simhash import KEY, links, majority, only, row_key

SHINGLE = 5
BANDS, ROWS, FEW, CHUNK = 30, 5, 24, 2000
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
TERMS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)


class Held:
    """Frames kept on the executors' disks until the block ends; what a lost executor held is made again."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        return self.frames[-1]

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_: object) -> None:
        for df in reversed(self.frames):
            df.unpersist()


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the different shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64))


def keys_of(own: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none of an empty one."""
    if not len(own):
        return []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for k in range(0, len(own), 2048):
        np.minimum(least, (FACTORS[:, None] * own[None, k : k + 2048] + TERMS[:, None]).min(axis=1), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both / (a + b - both) is 0.8 or more, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, __row_key, set, fp, keys); fp is the fingerprint of the set's shingles."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, fps, keys, ends = [], [], [], [0]
        for t in texts:
            own = shingles(t)
            ids.append(xxhash.xxh64_intdigest(own.tobytes()))
            fps.append(majority(own))
            keys += keys_of(own)
            ends.append(len(keys))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(ids), signed(fps), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(keys))], ["doc_id", KEY, "set", "fp", "keys"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias(KEY), "text")
    return map_texts(keyed, "text", work, f"doc_id long, {KEY} long, set long, fp long, keys array<long>")


def forest(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what all links between sets of ``asks`` and others join, given what labels say is joined."""
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), bool)
    label = label.copy()
    a, b = [], []
    for p in np.flatnonzero(asks).tolist():
        far = label != label[p]
        if not far.any():
            break
        own = codes[starts[p] : starts[p] + size[p]]
        held[own] = True
        both = np.add.reduceat(held[codes], starts, dtype=np.int64)
        held[own] = False
        linked = np.flatnonzero(far & similar(both, size, size[p]))
        if not len(linked):
            continue
        labels, first = np.unique(label[linked], return_index=True)
        a += [int(ids[p])] * len(labels)
        b += ids[linked[first]].tolist()
        label[np.isin(label, labels)] = label[p]
    return a, b


def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        a, b = [], []
        for own in batch.column(0).to_pylist():
            own = np.sort(np.array(own, np.int64))
            i, j = np.triu_indices(len(own), 1)
            a.append(own[i])
            b.append(own[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        hit = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            hit.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the tasks of (key, i, j, set, root, asks, shingles), sorted by the first three."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, roots, asks, raw = zip(*held, strict=True)
        a, b = forest(np.array(ids, np.int64), [np.frombuffer(x, np.uint64) for x in raw], np.array(roots, np.int64), np.array(asks, bool))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    last, held = None, []
    for batch in it:
        cols = [c.to_pylist() for c in batch.columns]
        for task, row in zip(zip(*cols[:3], strict=True), zip(*cols[3:], strict=True), strict=True):
            if held and task != last:
                yield from out(held)
                held = []
            last = task
            held.append(row)
    if held:
        yield from out(held)


def verify(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("set").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    return found.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(verified, "a long, b long")


def dealt(members: DataFrame) -> DataFrame:
    """(key, set, root) of crowded keys to (key, i, j, set, root, asks), a task for each key, i and j.

    Only keys whose sets are in several components have tasks. Block j of the sets outside the largest component asks
    block i of those in it, or block -1 - i of those outside."""
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    blocks = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    keys = keys.select("key", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("m"), blocks(F.col("n") - F.col("main.n")).alias("r"))
    rows = members.join(keys, "key").withColumn("asks", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("set"), F.when(F.col("asks"), F.col("r")).otherwise(F.col("m"))).cast("int")
    rows = rows.withColumn("own", own)
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = F.transform(upto("r"), lambda x: task(F.col("own"), x))
    asked = F.transform(upto("m"), lambda x: task(x, F.col("own")))
    others = F.transform(upto("r"), lambda x: task(-1 - F.least(F.col("own"), x), F.greatest(F.col("own"), x)))
    tasks = F.when(F.col("asks"), F.concat(asked, others)).otherwise(main)
    return rows.select("key", F.inline(tasks), "set", "root", "asks")


def by_fingerprint(distinct: DataFrame, held: Held) -> DataFrame:
    """Pairs (a, b) of the sets of ``distinct`` (set, fp): those of one fingerprint with its least, and the least ones of
    linked fingerprints."""
    least = held(distinct.groupBy("fp").agg(F.min("set").alias("least"), F.count(F.lit(1)).alias("count")))
    same = split_join(distinct.select("set", "fp"), least, "fp", "inner").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_set")) for c in "ab")
    met = links(least).join(x, "a").join(y, "b").select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))
    return held(same.unionByName(met).distinct())


def rooted(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the components of the sets of ``distinct`` (set, fp, keys, one: a row key of docs) that have links."""
    with Held() as held:
        return _rooted(docs, distinct, scratch, held)


def _rooted(docs: DataFrame, distinct: DataFrame, scratch: Scratch, held: Held) -> DataFrame:
    close = by_fingerprint(distinct, held)
    kept = distinct.select("set", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = held(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = held(split_join(kept, sizes.withColumn("count", F.col("n")), "key", "inner").select("set", "key", "n"))
    asked = met.select("set").unionByName(close.select(F.col("a").alias("set"))).unionByName(close.select(F.col("b").alias("set"))).distinct()
    wanted = asked.join(distinct.select("set", F.col("one").alias(KEY)), "set").select(KEY)

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [shingles(t).tobytes() for t in texts]
        return pa.RecordBatch.from_arrays([signed([xxhash.xxh64_intdigest(x) for x in raw]), pa.array(raw, pa.binary())], ["set", "shingles"])

    texts = docs.select(row_key().alias(KEY), "text").join(wanted.hint("merge"), KEY, "left_semi").dropDuplicates([KEY])
    sets = held(map_texts(texts.select("text"), "text", work, "set long, shingles binary"))
    few = met.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("set").alias("own")).select("own").mapInArrow(pairs, "a long, b long")
    many = met.where(F.col("n") > FEW).select("key", "set")
    pivots = held(many.groupBy("key").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("count")))
    stars = split_join(many, pivots, "key", "inner").where("set <> a").select("a", F.col("set").alias("b"))
    roots = components(verify(few.unionByName(stars).unionByName(close).distinct(), sets), scratch)
    members = held(many.join(roots, many.set == roots.node, "left").select("key", "set", F.coalesce("root", "set").alias("root")))
    tasks = dealt(members).join(sets, "set").select("key", "i", "j", "set", "root", "asks", "shingles")
    tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "set")
    more = held(tasks.mapInArrow(compared, "a long, b long"))
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.where("node <> root").toDF("a", "b")), scratch)


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one with the smallest doc_id."""
    scratch = Scratch(docs.sparkSession, "near_copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(KEY))
    own = sketches(docs).groupBy("set").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(KEY).alias("one"), F.min(order).alias("least"))
    distinct = scratch.save(own)
    roots = rooted(docs, distinct.drop("least"), scratch)
    least = distinct.join(roots, distinct.set == roots.node, "left").select(F.coalesce("root", "set").alias("root"), F.col("least").alias("one"))
    first = least.groupBy("root").agg(F.min("one").alias("one"))
    return only(docs, scratch.save(first.select(F.col(f"one.{KEY}").alias(KEY))))
