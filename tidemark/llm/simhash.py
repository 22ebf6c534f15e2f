"""Operator 3: SimHash near-duplicates found through the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect [23, 12, 7] code.
If two fingerprints differ in at most 4 bits, one pair of segments holds at most 2 of them, and, taking the pairs
in cyclic order, some pair (a, b) holds at most one in each or none in a and two in b. Every word has exactly one
codeword within distance 3, and that codeword is within 3 + e of any word that differs from it in e bits. So a
fingerprint asks, for each pair, under its own two nearest codewords, and is stored under all pairs of codewords
within (4, 4) and (3, 5): the two meet under at least one key, of 24 bits and the pair's number. Fingerprints that
meet are compared in full; no link is lost and no pair is guessed.

Equal fingerprints are made one before that, so copies never meet each other. Rows of a key are streamed in key
order; a key with many rows yields a spanning forest of its links and not its pairs.

Defined cases: null and wordless texts have fingerprint zero; rows with equal doc_id are linked like others; a null
doc_id never is a component's id unless all of its documents have none; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, map_texts, table

SHINGLE, BITS, SEED = 4, 4, 42
GOLAY = 0b110001110101  # generator polynomial of the binary Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))
FOREST_FROM = 24
KEY = "__row_key"


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes (uint64)."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(h)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, __row_key, fp), fp the fingerprint as a signed long."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", KEY, "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias(KEY), "text")
    return map_texts(keyed, "text", work, f"doc_id long, {KEY} long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the upper 12 bits, and by syndrome the error patterns of weight up to 5, lightest first and
    padded with -1, and their weights."""

    def mod(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    upper = np.array([mod(h << 11) for h in range(4096)], np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(6):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[int(upper[e >> 11]) ^ (e & 2047)].append((weight, e))
    width = max(map(len, found))
    pattern = np.full((2048, width), -1, np.int64)
    weights = np.full((2048, width), 99, np.int64)
    for s, own in enumerate(found):
        for k, (w, e) in enumerate(own):
            pattern[s, k], weights[s, k] = e, w
    return upper, pattern, weights


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints (uint64): key, row and whether it is the one the fingerprint asks under."""
    upper, pattern, weights = golay()
    words, marks = [], []
    for at, size in SEGMENTS:
        x = (fp >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)
        s = upper[x >> 11] ^ (x & 2047)
        words.append((x[:, None] ^ pattern[s]) >> 11)  # the upper 12 bits name a codeword
        marks.append(weights[s])
    keys, rows, asks = [], [], []
    for k, (a, b) in enumerate(PAIRS):
        wa, wb = (int((marks[i] <= 4).sum(axis=1).max(initial=1)) for i in (a, b))
        base = (k << 24) + (words[a][:, :wa, None] << 12)
        near = (marks[a][:, :wa, None] <= 4) & (marks[b][:, None, :wb] <= 4)
        i, j, m = np.nonzero(near)
        keys.append((base + words[b][:, None, :wb])[i, j, m])
        rows.append(i)
        asks.append(np.zeros(len(i), bool))
        i, m = np.nonzero(marks[b] == 5)  # the nearest codeword of a with those at distance 5 of b
        keys.append(base[i, 0, 0] + words[b][i, m])
        rows.append(i)
        asks.append(np.zeros(len(i), bool))
        keys.append(base[:, 0, 0] + words[b][:, 0])
        rows.append(np.arange(len(fp)))
        asks.append(np.ones(len(fp), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(asks)


def forest(nodes: np.ndarray, asks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links of ``asks`` (some of ``nodes``, both sorted) join, fewer than there are nodes.

    Nodes are only compared with those outside their component so far; the largest component is kept apart, so a dense
    cloud, which soon is one component, takes little more than one look at each node.
    """
    n = len(nodes)
    label, size = np.arange(n), np.ones(n, np.int64)
    main, out = 0, np.arange(1, n)  # the largest component's label, and the nodes outside it
    a, b = [], []
    for p in np.searchsorted(nodes, asks).tolist():
        if not len(out):
            break
        mine = label[p]
        far = out if mine == main else np.flatnonzero(label != mine)
        linked = far[np.bitwise_count((nodes[far] ^ nodes[p]).view(np.uint64)) <= bits]
        if not len(linked):
            continue
        labels, first = np.unique(label[linked], return_index=True)
        a.append(np.full(len(labels), nodes[p]))
        b.append(nodes[linked[first]])
        joined = np.append(labels, mine)
        new = int(joined[size[joined].argmax()])
        total = int(size[joined].sum())
        label[np.isin(label, joined)] = new
        size[new] = total
        if total >= size[main] or main in joined:
            main = new
            out = np.flatnonzero(label != main)
    none = nodes[:0]
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near(key: np.ndarray, fp: np.ndarray, asks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups of equal, sorted keys."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    start, stop = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
    size = stop - start
    group = np.repeat(np.arange(len(start)), size)
    few = np.flatnonzero(asks & (size > 2)[group] & (size <= FOREST_FROM)[group])
    a, b = [], []
    n = size[group[few]]
    i = np.repeat(few, n)
    j = np.repeat(start[group[few]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hit = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= bits) & (fp[i] < fp[j])
    a.append(fp[i][hit])
    b.append(fp[j][hit])
    for g in np.flatnonzero(size > FOREST_FROM):
        own = slice(start[g], stop[g])
        x, y = forest(np.unique(fp[own]), np.unique(fp[own][asks[own]]), bits)
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) whose closure is that of all pairs within ``bits`` (4 at most)."""
    if bits > BITS:
        raise ValueError("the keys hold up to 4 differing bits")

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 512):
                part = fp[k : k + 512]
                key, row, ask = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(part[row]), pa.array(ask)], ["key", "fp", "asks"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                a, b = near(key, fp, asks, bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in it:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # all of one key so far
            key, fp, asks = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield from out(key[:cut], fp[:cut], asks[:cut])
            held = [(key[cut:], fp[cut:], asks[cut:])]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    # a hundred keys come from each row, so the few bytes of fingerprints are dealt out first
    keyed = distinct.select("fp").repartition("fp").mapInArrow(emit, "key int, fp long, asks boolean")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One of the rows of ``docs`` for each row key of ``kept``."""
    key = fresh(docs, KEY)
    kept = kept.select(F.col(KEY).alias(key)).distinct()
    one = docs.withColumn(key, row_key()).join(kept.hint("merge"), key, "left_semi").dropDuplicates([key])
    return one.select(*[F.col(c) for c in docs.columns])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, text) to (doc_id, __row_key, fp, root, component_id): the smallest doc_id reachable over links of
    ``bits`` bits; root stands for the component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.save(fingerprints(docs, shingle))
    distinct = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = scratch.save(links(distinct, bits))
    roots = components(edges, scratch)
    scratch.drop(edges)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = scratch.save(rooted.join(least, "root").select("fp", "root", "component_id"))
    return own.join(by_fp, "fp").select("doc_id", KEY, "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: one with the smallest doc_id."""
    groups = near_duplicates(docs, shingle, bits)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))).alias("one"))
    return only(docs, first.select(F.col(f"one.{KEY}").alias(KEY)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
