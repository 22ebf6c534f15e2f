"""Operator 4: language identification by interpolated Kneser-Ney character models.

Words are lower-cased runs of letters that touch no digit (all runs of letters in a text without such), read as
characters between two marks; n-grams never leave a word, so a word's cross-entropy under each language depends on the
word alone and is kept in a bounded table of words seen. All languages share one sorted array of 64-bit n-gram hashes
for each order, with a column of discounted probabilities for each language, and another such array of contexts with
back-off weights. A document's language is the one with the lowest cross-entropy per character over its whole text; of
equal ones the first by name.

The models are fitted on a sample of at most ``per_language`` labelled documents for each language (those with the
smallest hashes of doc_id), which bounds their size whatever the corpus. A fifth of the sample is kept from the counts.
It gives the usual cross-entropy of each language. A word's excess is how far it lies above the usual under the language
that suits it best, and a text's excess is its words' mean by character, so that a text in two known languages has none.
The same fifth says how far texts lie if their own language is left out of the models. A document is rejected if its
excess is more than ``MARGIN`` of the least such distance, and ``z`` spreads of known texts too, allowing for its length.

Defined cases: a null text, or one without letters, has language ``und``, score 0 and is rejected; without any
labelled document every row is so; rows with a null language are never learned from; an empty table gives no rows;
repeated rows are predicted alike; other columns of the input are ignored or, in ``identify``, kept, where lang_pred,
score, cross_entropy, excess, symbols and accepted replace columns so named; ``known`` keeps all columns as they are.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, resident, table

ORDER, PER_LANGUAGE, KEPT_WORDS, TEMPERATURE, Z, MARGIN = 4, 500, 300_000, 4.0, 8.0, 0.45
ALONE = 1.0  # the distance where there is one language only
WORD, ANY = re.compile(r"(?<![^\W_])[^\W\d_]++(?!\d)"), re.compile(r"[^\W\d_]+")
BOS, EOS, CHARACTERS, CAP = 2, 3, 2000, 400
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all words in turn, with their marks: each symbol's place in its word, the hash of the n-gram that ends
    there for n up to ``order`` (meaningless where the word is shorter) and the number of its word."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    text = "".join(f"\x02{w}\x03" for w in words)
    sym = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    place = np.arange(len(sym)) - np.repeat(ends - lens, lens)
    h, out = np.zeros(len(sym), np.uint64), []
    for n in range(order):
        h = h.copy()
        h[n:] += sym[: len(sym) - n] * MULTIPLIERS[n]
        out.append(h)
    return place, out, np.repeat(np.arange(len(words)), lens)


@dataclass
class Model:
    languages: list[str]
    order: int = ORDER
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))  # share of an unseen character, by language
    hashes: list[np.ndarray] = field(default_factory=list)  # by order: sorted, then (n-gram, language)
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by language: cross-entropy
    margin: float = ALONE
    spread: float = 0.5

    @staticmethod
    def find(sorted_hashes: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
        out = np.full((len(asked), values.shape[1]), default, np.float32)
        if len(sorted_hashes):
            k = np.searchsorted(sorted_hashes, asked)
            k[k == len(sorted_hashes)] = 0
            hit = sorted_hashes[k] == asked
            out[hit] = values[k[hit]]
        return out

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log-likelihood by language, and its number of predicted symbols."""
        place, h, word = grams(words, self.order)
        at = np.flatnonzero(place > 0)
        p = self.find(self.hashes[0], self.shares[0], h[0][at], 0.0) + self.floor
        for n in range(1, self.order):
            deep = place[at] >= n
            rows = at[deep]
            a = self.find(self.hashes[n], self.shares[n], h[n][rows], 0.0)
            w = self.find(self.contexts[n], self.weights[n], h[n - 1][rows - 1], 1.0)
            p[deep] = a + w * p[deep]
        out = np.zeros((len(words), len(self.languages)))
        logs = np.log(p, dtype=np.float64)
        first = np.searchsorted(word[at], np.arange(len(words)))
        if len(words):
            out = np.add.reduceat(logs, first, axis=0)
        return out, np.bincount(word[at], minlength=len(words))


def counts_of(words: list[str], weight: np.ndarray, order: int) -> list[dict[str, np.ndarray]]:
    """By order: the n-grams' hashes, Kneser-Ney counts and contexts."""
    place, h, word = grams(words, order)
    out: list[dict[str, np.ndarray]] = []
    raw = weight[word]
    for n in range(order):
        ok = place >= max(n, 1)
        rows = np.flatnonzero(ok)
        g, first, inverse = np.unique(h[n][rows], return_index=True, return_inverse=True)
        count = np.bincount(inverse, raw[rows], len(g))
        if n < order - 1:  # the number of symbols seen before it, but plain counts where it starts a word
            longer = np.flatnonzero(place >= n + 1)
            _, one = np.unique(h[n + 1][longer], return_index=True)
            before = np.zeros(len(g))
            k = np.searchsorted(g, h[n][longer[one]])
            np.add.at(before, k, 1.0)
            inner = place[rows[first]] > n
            count = np.where(inner & (before > 0), before, count)
        context = h[n - 1][rows[first] - 1] if n else np.zeros(len(g), np.uint64)
        out.append({"g": g, "c": count, "x": context})
    return out


def fit(samples: dict[str, Counter], order: int = ORDER) -> Model:
    languages = sorted(samples)
    m = Model(languages, order, np.zeros(len(languages)))
    by = []
    for lang in languages:
        words = sorted(samples[lang])
        by.append(counts_of(words, np.array([samples[lang][w] for w in words], float), order) if words else None)
    for n in range(order):
        every = np.unique(np.concatenate([b[n]["g"] for b in by if b] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(np.concatenate([b[n]["x"] for b in by if b] or [np.zeros(0, np.uint64)]))
        shares, weights = np.zeros((len(every), len(languages)), np.float32), np.ones((len(contexts), len(languages)), np.float32)
        for k, b in enumerate(by):
            if not b:
                continue
            c = b[n]["c"]
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(contexts, b[n]["x"])
            total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
            shares[np.searchsorted(every, b[n]["g"]), k] = np.maximum(c - d, 0) / total[at]
            seen = total > 0
            weights[seen, k] = (np.minimum(d, 1) * kinds[seen] / total[seen]).clip(1e-6, 1)
        if n == 0:
            m.floor = (weights[0] / CHARACTERS if len(contexts) else np.full(len(languages), 1 / CHARACTERS)).astype(np.float32)
        m.hashes.append(every)
        m.shares.append(shares)
        m.contexts.append(contexts)
        m.weights.append(weights)
    return m


def words_of(text: bytes | None) -> list[str]:
    if not text:
        return []
    lower = text.decode("utf-8", "replace").lower()
    return WORD.findall(lower) or ANY.findall(lower)


class Scorer:
    """Sums over a text's words: log-likelihood by language, excess and symbols."""

    def __init__(self, model: Model, kept: int = KEPT_WORDS):
        self.m, self.kept = model, kept
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.m.languages) + 2))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log-likelihood by language, its excess and its number of symbols; 0 symbols without letters."""
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        new = set(flat).difference(self.at)
        if self.at and len(self.at) + len(new) > self.kept:
            self.clear()
            new = set(flat)
        part = list(new)
        for k in range(0, len(part), 20_000):
            own = part[k : k + 20_000]
            base, n = len(self.at), len(own)
            while base + n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            ll, size = self.m.score(own)
            letters = np.fromiter((any(map(str.isalpha, w)) for w in own), bool, n)
            over = np.zeros(n) if not len(self.m.usual) else (-ll - self.m.usual * size[:, None]).min(axis=1)
            self.rows[base : base + n, :-2] = ll * letters[:, None]
            self.rows[base : base + n, -2] = over * letters
            self.rows[base : base + n, -1] = size * letters
            self.at.update(zip(own, range(base, base + n), strict=True))
        idx = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        out = np.zeros((len(texts), len(self.m.languages) + 2))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero(lens)
        if len(some):
            starts = (np.cumsum(lens) - lens)[some]
            out[some] = np.add.reduceat(self.rows[idx], starts, axis=0)
        return out[:, :-2], out[:, -2], out[:, -1]


PREDICTED = "lang_pred string, score double, cross_entropy double, excess double, symbols long"
ADDED = [c.split()[0] for c in PREDICTED.split(", ")]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds to (text and others, none named as these) the language, its share among the languages, its cross-entropy
    and the excess over all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    names, own = docs.columns, uuid.uuid4().hex

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = resident(f"scorer {own}", lambda: Scorer(shared.value))
        m = scorer.m
        if m.languages:
            ll, over, n = scorer(texts)
        else:
            ll, over, n = np.zeros((len(texts), 1)), np.zeros(len(texts)), np.zeros(len(texts))
        best = ll.argmax(axis=1)
        top = ll[np.arange(len(ll)), best]
        share = 1 / np.exp(np.maximum((ll - top[:, None]) / TEMPERATURE, -700)).sum(axis=1)
        ok = n > 0
        lang = [m.languages[k] if o else "und" for k, o in zip(best, ok, strict=True)]
        each = np.maximum(n, 1)
        cols = [batch.column(i) for i in range(batch.num_columns)]
        cols += [pa.array(lang, pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, -top / each, 0.0)), pa.array(over / each), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, [*names, *ADDED])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_texts(docs, "text", work, f"{kinds}, {PREDICTED}", keeps=True)


def calibrate(aside: DataFrame, model: Model) -> None:
    """Sets the usual cross-entropies, the margin and the spread from documents (lang, text) kept from the counts.

    A row of sums for each document comes to the driver; the sample bounds them."""
    languages = model.languages

    def sums(extra: str, of) -> list:
        shared = aside.sparkSession.sparkContext.broadcast(model)

        def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
            m = shared.value
            rows = []
            for lang, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                count = Counter(w for w in words_of(t) if any(map(str.isalpha, w)))
                if count and lang in m.languages:
                    ll, n = m.score(list(count))
                    times = np.fromiter(count.values(), np.int64, len(count))
                    rows.append((lang, *of(m, m.languages.index(lang), ll, n, times), int(n @ times)))
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", *extra.split(), "n"])

        return map_texts(aside, "text", work, f"lang string, {', '.join(x + ' double' for x in extra.split())}, n long").collect()

    def own(m: Model, k: int, ll: np.ndarray, n: np.ndarray, times: np.ndarray) -> tuple[float, float]:
        return float(-ll[:, k] @ times), 0.0

    def left_out(m: Model, k: int, ll: np.ndarray, n: np.ndarray, times: np.ndarray) -> tuple[float, float]:
        over = -ll - m.usual * n[:, None]
        others = np.delete(over, k, axis=1)
        return float(over.min(axis=1) @ times), float(others.min(axis=1) @ times) if others.shape[1] else 0.0

    def by(rows: list, column: str) -> dict[str, float]:
        total, size = Counter(), Counter()
        for r in rows:
            total[r.lang] += r[column]
            size[r.lang] += r.n
        return {k: total[k] / size[k] for k in size}

    usual = by(sums("own none", own), "own")
    every = sum(usual.values()) / max(len(usual), 1)
    model.usual = np.array([usual.get(k, every) for k in languages])
    rows = sums("over others", left_out)
    apart = by(rows, "others")
    if len(languages) > 1 and apart:
        model.margin = MARGIN * max(min(apart.values()), 0.0)
    if rows:
        model.spread = max(float(np.sqrt(np.mean([(r.over / r.n) ** 2 * min(r.n, CAP) for r in rows]))), 0.5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> Model:
    """(doc_id, text, lang) to the models with their usual cross-entropies.

    Only the chosen documents' ids (``per_language`` for each language at most) and the counts of their words come
    to the driver."""
    spark = labelled.sparkSession
    ids = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    # far more than the wanted number of smallest hashes lies below this share of the hashes, and only those are sorted
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    ids = ids.join(F.broadcast(counts), "lang").where((F.col("__n") <= 8 * per_language) | (spot * F.col("__n") <= 2 * per_language + 100))
    rank = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = [r.doc_id for r in ids.withColumn("__k", F.row_number().over(rank)).where(F.col("__k") <= per_language).select("doc_id").collect()]
    if not chosen:
        return Model([], order)
    few = spark.createDataFrame([(i, k % 5 == 0) for k, i in enumerate(sorted(set(chosen)))], "doc_id long, aside boolean")
    sample = labelled.where("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").persist()

    def count(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for lang, t in zip(batch.column(0).to_pylist(), texts, strict=True):
            found.setdefault(lang, Counter()).update(words_of(t))
        rows = [(lang, w, c) for lang, own in found.items() for w, c in own.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    words = map_texts(sample.where("not aside").select("lang", "text"), "text", count, "lang string, word string, n long")
    samples: dict[str, Counter] = {}
    for r in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        samples.setdefault(r.lang, Counter())[r.word] = r.n
    model = fit(samples, order)
    calibrate(sample.where("aside").select("lang", "text"), model)
    sample.unpersist()
    return model


def identify(docs: DataFrame, model: Model, z: float = Z) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy, excess, symbols and accepted (false where the language is
    unknown)."""
    out = predict(docs.select(*[F.col(c) for c in docs.columns if c.lower() not in (*ADDED, "accepted")]), model)
    far = (F.col("excess") > model.margin) & (F.col("excess") * F.sqrt(F.least("symbols", F.lit(CAP))) > z * model.spread)
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & ~far)


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is known, with their columns."""
    safe = docs.select(*[F.col(c).alias("text" if c == "text" else f"__{k}") for k, c in enumerate(docs.columns)])
    kept = identify(safe, model).where("accepted")
    return kept.select(*[F.col("text" if c == "text" else f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


def learned_from(docs: DataFrame, **how) -> Model:
    return learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **how)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learned_from(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
