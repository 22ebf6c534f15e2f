"""An audit record: a tree of digests over files, by which a run is checked block by block.

Leaves are blocks of files, hashed where Spark's tasks read them, so no file is ever one row. A file's digest is that of
its blocks' digests, a folder's that of its members' names and digests, up to the root. A changed byte changes one block
and the nodes above it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64 << 20
PIECE = 4 << 20  # bytes a task holds at a time
NODES = "level string, name string, bytes long, digest string"


def opened(path: str):
    """A file for random reads: local paths by Python, others by Arrow's file systems."""
    if path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def digest_of(path: str, start: int, size: int) -> str:
    out = hashlib.sha256()
    with opened(path) as f:
        f.seek(start)
        while size > 0:
            piece = f.read(min(PIECE, size))
            if not piece:
                break
            out.update(piece)
            size -= len(piece)
    return out.hexdigest()


def leaves(spark: SparkSession, root: str, under: str = "", block: int = BLOCK) -> DataFrame:
    """(name, block, bytes, digest) of the files under a folder of ``root``, which may be a pattern; names are relative
    to the root. Hidden files, those whose names begin with an underscore and empty ones, which Spark doesn't list, are left out."""
    place = urlparse(root).path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{under}" if under else root).select("path", "length")
    name = F.substring(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", ""), len(place) + 2, 1 << 20)
    rows = files.select("path", name.alias("name"), "length", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / block) - 1).cast("int"))).alias("block"))
    rows = rows.withColumn("bytes", F.least(F.lit(block), F.col("length") - F.col("block").cast("long") * block).cast("long"))

    def digests(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield batch.assign(digest=[digest_of(p, int(k) * block, int(n)) for p, k, n in zip(batch["path"], batch["block"], batch["bytes"])])[["name", "block", "bytes", "digest"]]

    return rows.drop("length").repartition("name", "block").mapInPandas(digests, "name string, block int, bytes long, digest string")


def tree(blocks: DataFrame, depth: int = 3) -> DataFrame:
    """Leaves and all nodes above: (level, name, bytes, digest), level block, file, folder or root. ``depth`` is how many
    folders deep files may lie; deeper ones fail."""
    text = lambda parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(" ", *[x[c].cast("string") for c in parts])), "\n"), 256)
    out = [blocks.select(F.lit("block").alias("level"), F.concat("name", F.lit("#"), F.col("block").cast("string")).alias("name"), "bytes", "digest")]
    files = blocks.groupBy("name").agg(F.sum("bytes").alias("bytes"), text(["block", "digest"]).alias("digest"))
    out.append(files.select(F.lit("file").alias("level"), "name", "bytes", "digest"))
    nodes = files.withColumn("k", F.size(F.split("name", "/")) - 1)
    nodes = nodes.where(F.assert_true(F.col("k") <= depth, "a file lies deeper than the tree").isNull())
    for k in range(depth, 0, -1):
        here = nodes.where(F.col("k") == k)
        parent = F.regexp_replace("name", "/[^/]*$", "")
        up = here.groupBy(parent.alias("folder")).agg(F.sum("bytes").alias("bytes"), text(["name", "digest"]).alias("digest")).select(F.col("folder").alias("name"), "bytes", "digest")
        out.append(up.select(F.lit("folder").alias("level"), "name", "bytes", "digest"))
        nodes = nodes.where(F.col("k") < k).unionByName(up.withColumn("k", F.lit(k - 1)))
    top = nodes.agg(F.sum("bytes").alias("bytes"), text(["name", "digest"]).alias("digest"))
    out.append(top.select(F.lit("root").alias("level"), F.lit("").alias("name"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "digest"))
    return reduce(DataFrame.unionByName, out)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(level, name, change): nodes of two trees that only one has or whose digests differ; none if all is as it was."""
    side = lambda rows, c: rows.select("level", "name", F.col("digest").alias(c))
    both = side(before, "a").join(side(now, "b"), ["level", "name"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("level", "name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("changed").alias("change"))
