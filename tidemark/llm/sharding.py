"""Operator 7: shards of near equal bytes by a k-d tree over the documents' metadata, with DataFrame operations only.

A node of the tree that stands for several shards is split along the dimension in which its documents spread widest
(as a share of the whole table's range), at the weighted quantile that gives each side its shards' part of the bytes:
the weighted median where the number of shards is even. All nodes of a level are split together. The quantile is
found by histograms over the cluster: the bin that holds it is divided again, and once it holds a single value its
documents are ordered by a hash, until a bin's bytes no longer matter. What comes to the driver is at most
``BINS`` sums for each node of a level.

Each row keeps the number of its node in a column, written anew for each level (80 bytes a row, without the text). What
is known of a level's nodes is in arrays that the number indexes, so expressions stay of one size however many nodes
there are. Rows are numbered within shards without gathering a shard anywhere.

Dimensions: hashes of lang and source (equal values stay together as long as possible), the logarithm of the size,
and doc_id.

Defined cases: a null text has size 16 and the CRC of no bytes; nulls in metadata stand below all values; equal
metadata is told apart by a hash of doc_id and the text's CRC, and rows equal in these too, repeated ones or such
without a doc_id, by the order in which they were read, so they are split like others; a table with fewer documents
than shards leaves shards empty; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table

SHARDS, OVERHEAD, BINS, ROUNDS = 40, 16, 2048, 6
DIMS = ("d0", "d1", "d2", "d3")


KEPT = ("doc_id", "size", "text_crc32", *DIMS, "tie", "row")


@dataclass
class Node:
    """One of a level's nodes: its shards, and while it is being split the place of its quantile, rows of value lo to
    hi or of hash lo to hi among those of one value."""

    first: int
    shards: int
    dim: int = 0
    goal: float = 0.0
    lo: float = 0.0
    hi: float = 0.0
    before: float = 0.0
    value: float | None = None
    cut: tuple[float, float] | None = None  # documents below (value, hash) go left

    def narrow(self, bins: list[tuple[float, float, float]], enough: float) -> None:
        """bins: (least key, greatest key, bytes), rising."""
        total = self.before
        for least, most, w in bins:
            if total + w >= self.goal or (least, most, w) == bins[-1]:
                break
            total += w
        if (self.value is None and w <= enough) or (self.value is not None and (w <= enough or least == most)):
            end = abs(total + w - self.goal) < abs(total - self.goal)
            if self.value is None:
                self.cut = (most, 2.0) if end else (least, -1.0)
            else:
                self.cut = (self.value, math.nextafter(most, 9.0) if end else least)
        elif self.value is None and least == most:
            self.value, self.lo, self.hi, self.before = least, 0.0, 1.0, total
        else:
            self.lo, self.hi, self.before = least, most, total

    def halves(self) -> list[Node]:
        left = self.shards // 2
        return [Node(self.first, left), Node(self.first + left, self.shards - left)]


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as doubles, the tie's hash in [0, 1) and a number for the row.

    To be written before it is used: the number says in which order rows were read."""
    unit = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")).cast("double") / 2.0**32, F.lit(-1.0 / 2**20))
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        unit(F.col("lang")).alias("d0"),
        unit(F.col("source")).alias("d1"),
        F.log2(size.cast("double")).alias("d2"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("d3"),
        F.monotonically_increasing_id().alias("row"),
    )
    # 36 bits of the document, then 16 of the row
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 36)) * (1 << 16) + F.pmod(F.xxhash64("row"), F.lit(1 << 16))
    return rows.withColumn("tie", tie.cast("double") / 2.0**52).select(*KEPT)


def at(values: list, kind: str) -> Column:
    """The value of a row's node."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("node"))


def split(rows: DataFrame, level: list[Node], enough: float, spread: list[float]) -> None:
    """Finds the cuts of a level's nodes with several shards."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
    open_ = [x.shards > 1 for x in level]
    rows = rows.where(at(open_, "boolean"))
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
    for k, x in enumerate(level):
        r = found.get(k)
        if not open_[k]:
            continue
        if r is None:  # no documents: either cut will do
            x.cut = (0.0, 0.0)
            continue
        x.dim = max(range(len(DIMS)), key=lambda d: ((r[f"max_{DIMS[d]}"] - r[f"min_{DIMS[d]}"]) / spread[d], -d))
        x.goal = r["bytes"] * (x.shards // 2) / x.shards
        x.lo, x.hi = r[f"min_{DIMS[x.dim]}"], r[f"max_{DIMS[x.dim]}"]
    value = F.get(F.array(*DIMS), at([x.dim for x in level], "int"))
    for _ in range(ROUNDS * 2):
        going = [o and x.cut is None for o, x in zip(open_, level, strict=True)]
        if not any(going):
            break
        tied = [x.value is not None for x in level]
        part = rows.where(at(going, "boolean")).select("node", "size", "tie", value.alias("value"))
        part = part.where(~at(tied, "boolean") | (F.col("value") == at([x.value for x in level], "double")))
        part = part.select("node", "size", F.when(at(tied, "boolean"), F.col("tie")).otherwise(F.col("value")).alias("key"))
        part = part.where((F.col("key") >= at([x.lo for x in level], "double")) & (F.col("key") <= at([x.hi for x in level], "double")))
        share = (F.col("key") - at([x.lo for x in level], "double")) / at([max(x.hi - x.lo, 1e-300) for x in level], "double")
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        sums = part.groupBy("node", bin_.alias("bin")).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.sum("size").alias("bytes")).collect()
        bins: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: (r["node"], r["bin"])):
            bins.setdefault(r["node"], []).append((r["least"], r["most"], float(r["bytes"])))
        for k, own in bins.items():
            level[k].narrow(own, enough)
    for k, x in enumerate(level):
        if open_[k] and x.cut is None:
            x.cut = (x.lo, -1.0) if x.value is None else (x.value, x.lo)


def placed(rows: DataFrame, level: list[Node]) -> tuple[DataFrame, list[Node]]:
    """Rows with the numbers of their nodes in the next level, and that level."""
    below: list[Node] = []
    start = []
    for x in level:
        start.append(len(below))
        below += [x] if x.cut is None else x.halves()
    cut = [x.cut or (0.0, 0.0) for x in level]
    value = F.get(F.array(*DIMS), at([x.dim for x in level], "int"))
    rows = rows.withColumn("value", value).withColumn("edge", at([v for v, _ in cut], "double"))
    right = (F.col("value") > F.col("edge")) | ((F.col("value") == F.col("edge")) & (F.col("tie") >= at([h for _, h in cut], "double")))
    node = at(start, "int") + F.when(at([x.cut is not None for x in level], "boolean") & right, 1).otherwise(0)
    return rows.select(*KEPT, node.cast("int").alias("node")), below


def grow(rows: DataFrame, scratch: Scratch, shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, list[Node], int]:
    """Prepared rows with the numbers of their leaves, the leaves, for a number of shards or as many as
    ``target_bytes`` asks for, and the number of rows."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends).first()
    rows = rows.withColumn("node", F.lit(0))
    if whole["bytes"] is None:
        return rows, [Node(0, 1)], 0
    shards = shards or max(1, math.ceil(whole["bytes"] / target_bytes))
    spread = [max(whole[f"max_{c}"] - whole[f"min_{c}"], 1e-300) for c in DIMS]
    level = [Node(0, shards)]
    while any(x.shards > 1 for x in level):
        split(rows, level, whole["bytes"] / shards * 1e-4, spread)
        new, level = placed(rows, level)
        new = scratch.save(new)
        scratch.drop(rows)
        rows = new
    return rows, level, whole["n"]


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, lang, source) to doc_id, size, text_crc32, shard and slot."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows, level, n = grow(scratch.save(prepare(docs)), scratch, shards, target_bytes)
    own = rows.select("doc_id", "size", "text_crc32", "row", at([x.first for x in level], "int").alias("shard"))
    return numbered(own, scratch, ["shard"], ["doc_id", "size", "text_crc32", "row"], "slot", rows=n).drop("row")


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
