"""Labelling as a stream: new items are labelled once.

State by item key claims the first copy of an item that comes; repeats have nothing to do, and no label table is read.
An item older than the watermark, the point-in-time grace behind the newest one, is late: it goes to a table of its own
and not to the labels. A key's state goes when the watermark has passed its item, as a repeat would be late from then on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.label import keyword_label
from ..plans.rubric import DEFAULT, Rubric

ITEMS = "item_key string, symbol string, company string, title string, snippet string, published timestamp"
LABELS = "item_key string, symbol string, published timestamp, label struct<event_type:string,sentiment:int,governance_flag:boolean,about_company:boolean,substance:string,subject:string,occurred_at_company:boolean,severity:string,people_direction:string,role_tier:string,action_stage:string>"


def labelled(batch: DataFrame) -> DataFrame:
    return batch.select("item_key", "symbol", "published", keyword_label(F.col("title"), F.col("snippet"), F.col("company")).alias("label"))


def claim(keep_ms: int) -> Callable:
    """The state function: the first row of a key that isn't late, and all late rows of keys without a claim."""

    def first(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            (at,) = state.get
            if at is not None and mark <= at:
                state.setTimeoutDuration(keep_ms)  # a repeat wouldn't be late yet
            else:
                state.remove()
            return
        claimed = state.exists
        for rows in batches:
            late = rows["micros"] < mark * 1000  # undated rows never are
            if claimed:
                continue
            if not late.all():
                one = rows[~late].head(1)
                us = one["micros"].iloc[0]
                state.update((None if pd.isna(us) else int(us // 1000),))
                state.setTimeoutDuration(keep_ms)
                claimed = True
                yield one.drop(columns="published").assign(late=False)
            if late.any():
                yield rows[late].drop(columns="published").assign(late=True)

    return first


def claimed(items: DataFrame, r: Rubric = DEFAULT, keep_ms: int | None = None) -> DataFrame:
    """Streamed items as they are first seen, with late. Items without a key are told apart by symbol, title and text."""
    days = r["pit_grace_days"]
    made = F.sha2(F.to_json(F.struct("symbol", "title", "snippet", "published")), 256)
    rows = items.withColumn("item_key", F.coalesce("item_key", made)).withColumn("micros", F.unix_micros("published"))
    rows = rows.withWatermark("published", f"{days} days")
    out = "item_key string, symbol string, company string, title string, snippet string, micros long, late boolean"
    by = rows.groupBy("item_key").applyInPandasWithState(claim(keep_ms or days * 86_400_000), out, "at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return by.withColumn("published", F.timestamp_micros("micros")).drop("micros")


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, late: str | None = None, r: Rubric = DEFAULT, keep_ms: int | None = None) -> dict | None:
    """Labels all items that have come since the last call, then stops; returns the progress of the last batch.

    Labels go to ``target`` and late items to ``late`` (``target`` with _late behind it), a directory for each stream and
    batch, so that a batch that is run again takes its own place. What a stream has claimed is in its checkpoint: a
    new checkpoint is a new stream."""
    late = late or f"{target.rstrip('/')}_late"
    items = spark.readStream.schema(ITEMS).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        place = f"stream={own.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={n}"
        batch = batch.persist()  # two tables of one pass over the state
        for rows, path in ((labelled(batch.where("not late")), target), (batch.where("late").drop("late"), late)):
            if rows.head(1):
                rows.write.mode("overwrite").parquet(f"{path}/{place}")
        batch.unpersist()

    # batches without data would follow each other without end, as timers of processing time ask for them
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        stream = claimed(items, r, keep_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    stream.awaitTermination()
    return stream.lastProgress


def daily_counts(items: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Items by symbol and day as a stream; rows later than the grace are left out."""
    return items.withWatermark("published", f"{r['pit_grace_days']} days").groupBy("symbol", F.window("published", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
