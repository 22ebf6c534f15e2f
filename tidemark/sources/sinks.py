"""What a run writes: machine outputs, corpus tables, hand-offs, label cache and an audit manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold none."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(F.col(c)).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def machine_outputs(path: str, scores: DataFrame, evidence: DataFrame, dropped: DataFrame, meta: dict) -> None:
    """scorecard (CSV), scores, evidence and dropped (JSON lines) and run_meta under one folder, written once."""
    flat(scores).write.option("header", True).csv(f"{path}/scorecard")
    scores.write.json(f"{path}/scores")
    evidence.write.json(f"{path}/evidence")
    dropped.write.json(f"{path}/dropped")
    spark = scores.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(f"{path}/run_meta")


def read_run(spark: SparkSession, path: str, scores_schema: str, evidence_schema: str) -> tuple[DataFrame, DataFrame, dict]:
    """The scores, evidence and settings of a finished run."""
    meta = spark.read.text(f"{path}/run_meta").first()
    return spark.read.schema(scores_schema).json(f"{path}/scores"), spark.read.schema(evidence_schema).json(f"{path}/evidence"), json.loads(meta.value)


def write_pending(items: DataFrame, path: str) -> None:
    """Items that need a label, for someone else to label."""
    items.select("item_key", "symbol", "title", "snippet", "url").write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str, label_schema: str) -> DataFrame:
    """Labels handed back: the last one of each item by its text."""
    rows = spark.read.schema(f"item_key string, label {label_schema}").json(path).where("item_key is not null and label is not null")
    return rows.groupBy("item_key").agg(F.max_by("label", F.to_json("label")).alias("label"))


def append_labels(new: DataFrame, known: DataFrame | None, path: str) -> None:
    """Adds labels of items that the cache doesn't hold."""
    rows = new.dropDuplicates(["item_key"])
    if known is not None:
        rows = rows.join(known.select("item_key"), "item_key", "left_anti")
    rows.write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each file under a folder with its length and SHA-256, read by the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
