"""Grouped loops over sorted rows, for steps in which what a row is held against changes as the loop runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BATCH = 4096


def over_groups(df: DataFrame, keys: list[str], order: list[str], loop: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``loop`` makes of each group's rows (a stream of tuples, in order) as rows of ``schema``.

    Rows are dealt by the keys and sorted, so groups come as a stream and a loop holds what it keeps of one group; many
    small groups cost no more than their rows.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(rows(it), key=lambda r: tuple(r[k] for k in at)):
            out.extend(loop(group))
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
