"""A corpus pipeline of five training-data operators over the table ``documents``.

Each stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name, and returns what its operator's docstring says for them: a document without letters has no known language and goes;
a null text stays null until packing, where it is the end id alone; rows equal in doc_id and text are one document from
the near copies on. All stages but the last return the columns that they get.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, lines, near_copies, packing
from tidemark.llm.common import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject."""
    return language.known(docs, language.learned_from(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; n_chars follows the text."""
    safe = docs.select(*[F.col(c).alias(c if c in ("doc_id", "text") else f"__{k}") for k, c in enumerate(docs.columns)])
    out = lines.clean(safe)
    told = {c: F.col(c if c in ("doc_id", "text") else f"__{k}") for k, c in enumerate(docs.columns)}
    if "n_chars" in told:
        told["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in told.items()])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more, of which operator
    3's fingerprints and Golay keys give the candidates, and minimum hashes those beyond four bits."""
    return near_copies.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the language models, the fingerprints or the latent space; tests/llm/test_pipeline.py holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
