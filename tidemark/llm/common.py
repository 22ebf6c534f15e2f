"""What the operators share: scratch tables, gapless numbering, Arrow plumbing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import components
from ..sources.scratch import Scratch

__all__ = ["Scratch", "components", "fresh", "map_texts", "numbered", "release", "resident", "slices", "split_join", "table"]

_RESIDENT: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches, one thing at a time.

    Workers outlive a stage and serve the next one, so a table that one operator filled must go before another
    operator fills its own.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    """Gives freed memory back to the system where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't hold."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def split_join(left: DataFrame, right: DataFrame, key: str, how: str, parts: int = 1000) -> DataFrame:
    """``left`` joined ("inner" or "left_semi") with ``right``: one row for each key and its ``count`` in left.

    Keys with a ``parts``-th of all counted rows, ``parts`` of them at most whatever the data, are broadcast, so their
    rows stay where they are; the others meet by a shuffle. Other columns of right are added by an inner join.
    ``right`` must give the same rows on each read.
    """
    total = right.agg(F.sum("count").alias("n")).first().n or 0
    least = max(total // parts, 1)
    hot = right.where(F.col("count") > least).drop("count")
    cold = right.where(F.col("count") <= least).drop("count")
    if not hot.head(1):
        return left.join(cold.hint("merge"), key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key, how)
    return rest.unionByName(left.join(F.broadcast(hot), key, how))


def numbered(df: DataFrame, scratch: Scratch, keys: list[str], tie: list[str], out: str, buckets: int = 256, rows: int = 0) -> DataFrame:
    """Adds ``out``: a gapless number from 0 within ``keys``, in the order of a hash of ``tie`` and then ``tie``.

    The rows of a key are dealt over ``buckets``, or as many as give a bucket 200,000 of ``rows``, by that hash and counted there; sums of the counts before a
    bucket shift the numbers within it. No task holds a whole key. ``df`` must give the same rows on each read.
    """
    buckets = max(buckets, rows // 200_000)
    hashed = df.withColumn("__b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = hashed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    shifts = scratch.save(shifts)
    inner = Window.partitionBy(*keys, "__b").orderBy(*tie)
    # shifts has one row per key and bucket
    ranked = hashed.withColumn("__r", F.row_number().over(inner) - 1)
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "__b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    cols = [F.col(f"r.{c}").alias(c) for c in df.columns]
    return ranked.alias("r").join(shifts.alias("s"), cond).select(*cols, (F.col("r.__r") + F.col("s.__shift")).cast("long").alias(out))


def slices(lengths: pa.Array, most: int = 4 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(start, stop) over rows whose byte lengths are given: at most ``rows`` rows and about ``most`` bytes each."""
    start = total = 0
    for k, n in enumerate(lengths.to_pylist()):
        total += n or 0
        if total > most or k - start >= rows:
            if k > start:
                yield start, k
                start, total = k, n or 0
    if len(lengths) > start:
        yield start, len(lengths)


def map_texts(df: DataFrame, text: str, fn: Callable[[list[bytes | None], pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 4 << 20, keeps: bool = False) -> DataFrame:
    """mapInArrow over slices of about ``most`` bytes of ``text``, which ``fn`` gets as bytes (UTF-8, None if null).
    Unless ``fn`` ``keeps`` something resident, what an operator before has kept in the worker goes first."""
    import pyarrow.compute as pc

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _RESIDENT and not keeps:
            _RESIDENT.clear()
            release()
        for batch in it:
            col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            for a, b in slices(pc.binary_length(col), most):
                out = fn(col.slice(a, b - a).to_pylist(), batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
