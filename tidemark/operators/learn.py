"""Lessons from runs: proposals that a person accepts or rejects; accepted ones patch the rubric."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rubric import Rubric, load_rubric

REGISTRY = "lesson_id string, kind string, key string, status string, patch string, note string"


def propose(found: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with proposals (kind, key, lesson_id) that it didn't hold; proposing again adds nothing."""
    new = found.join(registry.select("lesson_id"), "lesson_id", "left_anti")
    return registry.unionByName(new.select("lesson_id", "kind", "key", F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("patch"), F.lit("").alias("note")))


def decide(registry: DataFrame, lesson_id: str, status: str, patch: dict | None = None, note: str = "") -> DataFrame:
    """The registry with one lesson accepted, with a patch of the rubric, or rejected."""
    if status not in ("accepted", "rejected"):
        raise ValueError(status)
    hit = F.col("lesson_id") == lesson_id
    text = F.lit(json.dumps(patch, sort_keys=True) if patch else None).cast("string")
    return registry.select("lesson_id", "kind", "key", F.when(hit, status).otherwise(F.col("status")).alias("status"), F.when(hit, text).otherwise(F.col("patch")).alias("patch"), F.when(hit, note).otherwise(F.col("note")).alias("note"))


def patched(registry: DataFrame) -> Rubric:
    """The rubric with the patches of accepted lessons, in the order of their ids; proposals change nothing."""
    rows = registry.where("status = 'accepted' and patch is not null").orderBy("lesson_id").select("patch").collect()  # one for each decision of a person
    return load_rubric(*(json.loads(r.patch) for r in rows))


def status(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
