"""Operator 6: weak supervision over quality rules.

Eight rules look at a text and vote good or bad, or abstain. The votes of a document form one of 3^8 patterns;
only the number of documents with each pattern goes to the driver. There, expectation-maximisation estimates the
share of good documents and each rule's accuracy on either class, given that it votes, without labels, and gives each
pattern a posterior probability of good quality. Accuracies are estimates without bounds: bad documents are of several
kinds, and a rule for one kind is often wrong on the others. What names the classes is the start, at which a document
is in the class that most of its votes say. How often a rule votes at all is told apart from that (``coverage``) and is
no evidence. A document is kept if that is at least one half, in place of a rule that all must pass,
and if it doesn't fail the base rule.

Defined cases: a null text has no words, and so fails the base rule, as does an empty one; every rule abstains on
it; repeated rows are judged alike and each counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_texts, table

#: Name, value at or below which it votes good, value from which it votes bad.
RULES = (
    ("symbols_per_word", 0.05, 0.25),
    ("odd_endings", 0.1, 0.25),
    ("other_characters", 0.12, 0.2),
    ("upper_share", 0.15, 0.4),
    ("letterless_share", 0.1, 0.2),
    ("repeat_share", 0.02, 0.15),
    ("dup_line_share", 0.1, 0.35),
    ("same_words", 0.6, 0.8),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = b" \t\n\x0b\x0c\r"
FOLLOWING = bytes(range(0x80, 0xC0))
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)])
ODD = b"#*$%&|<>!?=_~^@\\/+"
PLAIN = bytes(c for c in range(33, 127) if not chr(c).isalpha())
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += (w[k : k + n] ^ (w[k : k + n] >> np.uint64(29))) * FACTORS[k % 5]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    seen = Counter(tuple(words[i : i + width]) for i in at)  # the words themselves decide
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + width])] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[tuple[int, ...], int]:
    """The base counts, and the rules' votes as a number in base 3 (0 abstains, 1 good, 2 bad)."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, FOLLOWING + SPACE))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    base = (n, chars, symbols, dup, repeats)
    if not n:
        return base, 0
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    values = (
        symbols / n,
        sum(1 for w in words if w[-1] in ODD) / n,
        len(text.translate(None, LETTERS + SPACE)) / len(text.translate(None, SPACE)),
        upper / letters if letters else None,
        sum(1 for w in words if not w.strip(PLAIN)) / n,
        repeats / n,
        dup / len(lines) if len(lines) > 2 else None,
        1 - len(set(words)) / n if n >= 50 else None,
    )
    code = 0
    for v, (_, good, bad) in zip(values, RULES, strict=True):
        code = code * 3 + (0 if v is None else 1 if v <= good else 2 if v >= bad else 0)
    return base, code


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, the base counts and the pattern of votes."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in texts]
        cols = [batch.column(0)] + [pa.array([f[0][k] for f in found], pa.int64()) for k in range(5)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([f[1] for f in found], pa.int32())], ["doc_id", *BASE, "pattern"])

    return map_texts(docs.select("doc_id", "text"), "text", work, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", pattern int")


def digits(pattern: int, rules: int = len(RULES)) -> list[int]:
    return [pattern // 3 ** (rules - 1 - k) % 3 for k in range(rules)]


def estimate(counts: dict[int, int], rules: int = len(RULES), rounds: int = 500) -> tuple[dict[int, float], float, np.ndarray]:
    """Posterior probability of good quality by pattern, the share of good documents, and each rule's accuracies on
    good and on bad documents, given that it votes. One vote of accuracy 0.8 is added to each rule's counts, and one
    document to each class."""
    if not counts:
        return {}, 0.5, np.full((rules, 2), 0.8)
    patterns = sorted(counts)
    v = np.array([digits(p, rules) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    majority = np.sign((v == 1).sum(axis=1) - (v == 2).sum(axis=1))
    post = 0.5 + 0.4 * majority
    good, accuracy = 0.5, np.full((rules, 2), 0.8)
    for _ in range(rounds):
        good = float((n @ post + 1) / (n.sum() + 2))
        ll = np.tile(np.log([good, 1 - good]), (len(n), 1))
        for c, weight in enumerate((n * post, n * (1 - post))):
            for k in range(rules):
                right, voted = v[:, k] == c + 1, v[:, k] > 0
                accuracy[k, c] = (weight @ right + 0.8) / (weight @ voted + 1)
                ll[:, c] += np.where(right, np.log(accuracy[k, c]), np.where(voted, np.log(1 - accuracy[k, c]), 0.0))
        new = 1 / (1 + np.exp(np.clip(ll[:, 1] - ll[:, 0], -700, 700)))
        done = np.abs(new - post).max() < 1e-10
        post = new
        if done:
            break
    return dict(zip(patterns, post.tolist(), strict=True)), good, accuracy


def coverage(counts: dict[int, int], posterior: dict[int, float], rules: int = len(RULES)) -> np.ndarray:
    """The share of good and of bad documents on which each rule votes."""
    patterns = sorted(counts)
    voted = np.array([digits(p, rules) for p in patterns]).reshape(-1, rules) > 0
    n, post = np.array([counts[p] for p in patterns], float), np.array([posterior[p] for p in patterns])
    return np.stack([(weight @ voted + 0.5) / (weight.sum() + 1) for weight in (n * post, n * (1 - post))], axis=1)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, the base counts, base_failed, the posterior probability and kept."""
    spark = docs.sparkSession
    own = Scratch(spark, "quality").save(votes(docs))
    counts = {r["pattern"]: r["count"] for r in own.groupBy("pattern").count().collect()}  # 3^8 rows at most
    posterior, _, _ = estimate(counts)
    by = spark.createDataFrame([(k, float(v)) for k, v in posterior.items()], "pattern int, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return own.join(F.broadcast(by), "pattern").select("doc_id", *BASE, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= 0.5)).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
