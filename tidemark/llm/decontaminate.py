"""Operator 1: benchmark decontamination by latent semantic retrieval.

Texts become sequences of the benchmark's words (lower-cased runs of ASCII letters and digits and other characters
beyond ASCII); words of no item can't count for a match and become -1. Passages are windows of 32 words. Over the
passages of all documents a randomised singular value decomposition of their TF-IDF matrix A is made in one pass:
each task adds up its part of B = A'(A G) for a random matrix G of ``RANK`` columns, parts are summed by blocks of
words, and the driver gets B, which the benchmark bounds. B (G'B)^-1 B' is A'A in low rank; its eigenvectors, over
their singular values, place passages and items in the latent space. Windows that overlap by half are compared with
all items, in blocks, and those whose cosine reaches ``COSINE`` are candidates.

A candidate is a leak if the longest common subsequence of the item and the words around the window holds
``SHARE`` of the item's words, and half of the item's answer words (those of its ``answer``, else the rarer half of its words)
are among the words around the window. So reordered or replaced words may part the text from the item.

Words in more than ``MAX_DF`` of the passages are left out of the space, except those of items that would keep fewer
than ``LEAST_TERMS`` words. There is one vocabulary, one space and one encoding of the documents for the whole benchmark;
only the search takes items in blocks of about ``BLOCK_BYTES``, and its pairs don't depend on how they are dealt. The
benchmark's words, not the documents, go through the driver: it holds about 30 bytes for each byte of different words.

An item of fewer than ``LEAST_WORDS`` words says too little for a common subsequence: it is found where its words stand
in a text in sequence.

Defined cases: null and empty texts match nothing; items without a word, null ones included, match nothing; repeated
items are matched each; rows equal in doc_id and text give equal pairs once; an empty table of documents or items gives
no rows; other columns of the input are ignored, and kept in ``decontaminated`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_texts, table

WINDOW, STEP, RANK, COSINE, SHARE, ANSWER = 32, 16, 64, 0.45, 0.6, 0.5
MAX_DF, LEAST_TERMS, LEAST_WORDS, TERMS, MEMBER = 0.05, 8, 5, 512, 1 << 26
BLOCK_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
KEY = "__row_key"
#: Bytes of words in lower case, spaces for the others.
BYTES = bytes(k if k >= 128 or chr(k).isalnum() else 32 for k in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """The text's words (``WORD``) in lower case."""
    return text.translate(BYTES).split()


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    answers: list[set[int]]
    vocabulary: dict[bytes, int]

    def blocks(self, most: int) -> list[list[int]]:
        """The items' numbers in blocks of about ``most`` bytes, at four bytes a word and 64 an item."""
        out, total = [], most
        for k, w in enumerate(self.words):
            if total >= most:
                out.append([])
                total = 0
            out[-1].append(k)
            total += 4 * len(w) + 64
        return out


def read_items(rows: list) -> Items:
    out = Items([], [], [], {})
    number = lambda t: np.array([out.vocabulary.setdefault(w, len(out.vocabulary)) for w in words_of((t or "").encode())], np.int32)
    for item_id, text, answer in rows:
        words = number(text)
        if len(words):
            out.ids.append(item_id)
            out.words.append(words)
            out.answers.append(set(number(answer).tolist()))
    return out


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, __row_key, text) to (doc_id, __row_key, words), the numbers as bytes, without texts that share no
    word with any item."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    kind = "<i2" if len(items.vocabulary) < 1 << 15 else "<i4"

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        get, rows, own = vocabulary.value.get, [], []
        for k, t in enumerate(texts):
            if t:
                found = np.array(list(map(get, words_of(t), repeat(-1))), kind)
                if found.max(initial=-1) >= 0:
                    rows.append(k)
                    own.append(found.tobytes())
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own, pa.binary())], ["doc_id", KEY, "words"])

    return map_texts(docs.select("doc_id", KEY, "text"), "text", work, f"doc_id long, {KEY} long, words binary")


def windows(words: list[np.ndarray]) -> np.ndarray:
    """The words of documents in rows of WINDOW, which don't overlap; -1 fills up."""
    sizes = [-(-len(w) // WINDOW) for w in words]
    out = np.full((sum(sizes), WINDOW), -1, words[0].dtype if words else np.int16)
    flat, at = out.reshape(-1), 0
    for w, n in zip(words, sizes, strict=True):
        flat[at : at + len(w)] = w
        at += n * WINDOW
    return out


def chunks(batch: pa.RecordBatch, kind: str, most: int = 400_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The documents' words, about ``most`` at a time, with the number of the first document."""
    held, first, total = [], 0, 0
    for k, raw in enumerate(batch.column(batch.schema.get_field_index("words")).to_pylist()):
        w = np.frombuffer(raw, kind)
        if held and total + len(w) > most:
            yield first, held
            held, first, total = [], k, 0
        held.append(w)
        total += len(w)
    if held:
        yield first, held


def frequencies(encoded: DataFrame, kind: str, n: int) -> tuple[np.ndarray, int]:
    """The number of passages that hold each word, and of all passages."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(n, np.int64), 0
        for batch in it:
            for _, words in chunks(batch, kind):
                rows = np.sort(windows(words), axis=1)
                new = rows >= 0
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                df += np.bincount(rows[new], minlength=n)
                passages += len(rows)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], passages))], ["word", "n"])

    df, passages = np.zeros(n, np.int64), 0
    for r in encoded.select("words").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            passages = r.n
        else:
            df[r.word] = r.n
    return df, passages


def weigh(items: Items, df: np.ndarray, passages: int) -> np.ndarray:
    """The words' weights: squared inverse document frequencies, 0 for words left out."""
    idf = np.log((passages + 1) / (df + 1))
    rare = df <= MAX_DF * passages
    for words in items.words:
        if len(words) >= LEAST_WORDS and rare[np.unique(words)].sum() < LEAST_TERMS:
            rare[words] = True
    return np.where(rare, np.maximum(idf, 1e-3) ** 2, 0.0)


def padded(vectors: np.ndarray) -> np.ndarray:
    """The vectors and one of zeros, which -1 takes."""
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])


def sums(rows: np.ndarray, width: int, vectors: np.ndarray) -> np.ndarray:
    """Each row's sum of ``padded`` vectors, of a flat sequence of words in rows of ``width``."""
    places = rows.reshape(-1, width)
    out = np.zeros((len(places), vectors.shape[1]), np.float32)
    for k in range(width):  # a table of all places would be ``width`` times as large
        out += vectors[places[:, k]]
    return out


def sketch(encoded: DataFrame, kind: str, weight: np.ndarray, rank: int) -> np.ndarray:
    """A'(A G), A the passages' weighted word counts with rows of length 1; G from a seed."""
    n = len(weight)

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = padded(test_matrix(n, rank) * weight[:, None].astype(np.float32))
        total = np.zeros((n, rank), np.float64)
        for batch in it:
            for _, words in chunks(batch, kind):
                flat = windows(words).reshape(-1)
                y = sums(flat, WINDOW, g)
                at = np.flatnonzero((flat >= 0) & (weight[flat] > 0))
                ids, row = flat[at], at // WINDOW
                w = weight[ids]
                length = np.sqrt(np.bincount(row, w * w, len(y)))  # of plain counts; a word twice in a passage is rare
                y /= np.maximum(length, 1e-12)[:, None] ** 2
                order = np.argsort(ids, kind="stable")
                if len(order):
                    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
                    own = ids[order][starts]
                    total[own] += np.add.reduceat(y[row[order]], starts, axis=0) * weight[own, None]
        for k in range(0, n, TERMS):
            yield pa.RecordBatch.from_arrays([pa.array([k // TERMS], pa.int32()), pa.array([total[k : k + TERMS].tobytes()], pa.binary())], ["block", "part"])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in it:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(part, np.float64)
                found[k] = found[k] + x if k in found else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "part"])

    schema = "block int, part binary"
    parts = encoded.select("words").mapInArrow(add, schema).repartition(-(-n // TERMS), "block").mapInArrow(join, schema).collect()
    out = np.zeros((n, rank))
    for r in parts:
        x = np.frombuffer(r.part, np.float64).reshape(-1, rank)
        out[r.block * TERMS : r.block * TERMS + len(x)] = x
    return out


def test_matrix(n: int, rank: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((n, rank), np.float32)


def space(b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each word's vector: its weight times its row of the right singular vectors over the singular values."""
    n, rank = b.shape
    core = test_matrix(n, rank).T.astype(np.float64) @ b
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0), 1e-300) * 1e-9
    if not keep.any():
        return np.zeros((n, 1), np.float32)
    u, s, _ = np.linalg.svd(b @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)  # s: singular values of A
    keep = s > s.max() * 1e-6
    return (weight[:, None] * u[:, keep] / s[keep]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """The length of the longest common subsequence with an item, whose words' places are bits of ``masks``."""
    ones = (1 << size) - 1
    v = ones
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return size - v.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def judged(words: np.ndarray, window: int, item: np.ndarray, masks: dict[int, int], answer: set[int], share: float, held: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[int, float] | None:
    """The common length and the share of answer words around a window, if they make a leak; ``held``, if given, tells
    words that the item may hold from others, which no common subsequence has."""
    near = words[max(0, window - len(item)) : window + WINDOW + len(item)]
    own = near if held is None else near[held(near.astype(np.int64))]
    n = common(masks, len(item), own.tolist())
    if n < share * len(item):
        return None
    seen = len(answer.intersection(near.tolist())) / len(answer) if answer else 1.0
    return (n, seen) if seen >= ANSWER else None


class Held:
    """Which words an item holds, in a table of ``MEMBER`` cells at most; beyond that items may share cells, which lets
    more candidates through to the exact test."""

    def __init__(self, words: list[np.ndarray], vocabulary: int):
        self.width = vocabulary
        self.cells = np.zeros(min(max(len(words) * vocabulary, 1), MEMBER), bool)
        for k, w in enumerate(words):
            self.cells[(k * vocabulary + w.astype(np.int64)) % len(self.cells)] = True

    def one(self, item: int, words: np.ndarray) -> np.ndarray:
        return self.cells[(item * self.width + words) % len(self.cells)] & (words >= 0)

    def __call__(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self.cells[(item[:, None] * self.width + words) % len(self.cells)] & (words >= 0)


def enough(flat: np.ndarray, base: np.ndarray, ends: np.ndarray, start: np.ndarray, lengths: np.ndarray, member: Held, item: np.ndarray, share: float) -> np.ndarray:
    """Whether the words around a window, in or out of order, hold ``share`` of the item's number of words, without
    which no common subsequence can."""
    out = np.zeros(len(item), bool)
    width = np.arange(WINDOW + 2 * int(lengths.max(initial=0)))
    step = max(1, (1 << 18) // len(width))
    for k in range(0, len(item), step):
        own = slice(k, k + step)
        left = base[own] + np.maximum(start[own] - lengths[own], 0)
        right = np.minimum(base[own] + start[own] + WINDOW + lengths[own], ends[own])
        at = left[:, None] + width
        words = np.where(at < right[:, None], flat[np.minimum(at, len(flat) - 1)], -1)
        out[own] = member(item[own], words.astype(np.int64)).sum(axis=1) >= share * lengths[own]
    return out


class Phrases:
    """Items of a few words, found where their words stand in sequence."""

    def __init__(self, words: list[np.ndarray], answers: list[set[int]]):
        self.words, self.answers = words, answers
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(w) for w in words if len(w) < LEAST_WORDS}:
            own = [k for k, w in enumerate(words) if len(w) == n]
            h = np.array([self.mix(words[k].astype(np.int64), n)[0] for k in own], np.uint64)
            order = np.argsort(h, kind="stable")
            self.by[n] = h[order], np.array(own)[order]

    @staticmethod
    def mix(words: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n):
            out = (out + words[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def found(self, words: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, words, share of answer words) of the items that a document's words hold."""
        for n, (hashes, items) in self.by.items():
            asked = self.mix(words.astype(np.int64), n)
            first, last = np.searchsorted(hashes, asked), np.searchsorted(hashes, asked, "right")
            best: dict[int, float] = {}
            for at in np.flatnonzero(last > first).tolist():
                for i in items[first[at] : last[at]].tolist():
                    if best.get(i, 0.0) < 1.0 and (words[at : at + n] == self.words[i]).all():
                        answer = self.answers[i]
                        near = words[max(0, at - WINDOW) : at + n + WINDOW].tolist()
                        seen = len(answer.intersection(near)) / len(answer) if answer else 1.0
                        best[i] = max(best.get(i, 0.0), seen)
            yield from ((i, n, seen) for i, seen in best.items() if seen >= ANSWER)


PAIRS = f"doc_id long, {KEY} long, item_id long, cosine double, common_words long, item_words long, answer_share double"


def rarer_half(words: np.ndarray, df: np.ndarray) -> set[int]:
    own = sorted(set(words.tolist()), key=lambda x: (df[x], x))
    return set(own[: (len(own) + 1) // 2])


def search(encoded: DataFrame, kind: str, items: Items, block: list[int], weight: np.ndarray, vectors: np.ndarray, df: np.ndarray, cosine: float, share: float) -> DataFrame:
    """The pairs of a document and one of a block of items."""
    words, given = [items.words[k] for k in block], [items.answers[k] for k in block]
    long = np.array([k for k, w in enumerate(words) if len(w) >= LEAST_WORDS], np.int64)
    rare = [a or rarer_half(w, df) for w, a in zip(words, given, strict=True)]
    placed = np.stack([vectors[words[k]].sum(axis=0) for k in long]) if len(long) else np.zeros((0, vectors.shape[1]), np.float32)
    shared = encoded.sparkSession.sparkContext.broadcast(([items.ids[k] for k in block], words, given, rare, weight, vectors, long, unit(placed)))

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_words, given, answers, weight, vectors, long, q = shared.value
        phrases = Phrases(item_words, given)
        masks = {int(k): masks_of(item_words[k]) for k in long}
        lengths = np.fromiter(map(len, item_words), np.int64, len(item_words))
        member = Held(item_words, len(weight))
        step = max(16, (1 << 24) // max(len(long), 1))
        vectors = padded(vectors)
        for batch in it:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: dict[tuple[int, int], list] = {}
            for first, words in chunks(batch, kind):
                if phrases.by:
                    for k, w in enumerate(words):
                        for i, n, seen in phrases.found(w):
                            found[(first + k, i)] = [1.0, n, seen]
                sizes = np.array([-(-len(w) // STEP) for w in words])
                flat = np.full(int(sizes.sum()) * STEP, -1, kind)
                at = 0
                for w, n in zip(words, sizes.tolist(), strict=True):
                    flat[at : at + len(w)] = w
                    at += n * STEP
                half = sums(flat, STEP, vectors)
                doc = np.repeat(np.arange(len(words)), sizes)
                x = half.copy()
                x[:-1][doc[:-1] == doc[1:]] += half[1:][doc[:-1] == doc[1:]]
                x = unit(x)
                start = (np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * STEP
                base = (np.cumsum(sizes) - sizes) * STEP  # where a document's words are in ``flat``
                ends = base + np.fromiter(map(len, words), np.int64, len(words))
                for k in range(0, len(x) if len(long) else 0, min(step, 4096)):
                    c = x[k : k + min(step, 4096)] @ q.T
                    r, near = np.nonzero(c >= cosine)
                    like, i = c[r, near], long[near]
                    d = doc[k + r]
                    ok = enough(flat, base[d], ends[d], start[k + r], lengths[i], member, i, share)
                    for r, i, d, cos in zip(r[ok].tolist(), i[ok].tolist(), d[ok].tolist(), like[ok].tolist(), strict=True):
                        pair = (first + d, i)
                        got = judged(words[d], int(start[k + r]), item_words[i], masks[i], answers[i], share, partial(member.one, i))
                        if got and (pair not in found or found[pair][1:] < [got[0], got[1]]):
                            found[pair] = [cos, *got]
            rows = [(docs[d], keys[d], ids[i], v[0], v[1], len(item_words[i]), v[2]) for (d, i), v in found.items()]
            kinds = (pa.int64(),) * 3 + (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            names = [c.split()[0] for c in PAIRS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return encoded.mapInArrow(look, PAIRS)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = SHARE, rank: int = RANK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document (doc_id, __row_key) and an item that its text holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    queries = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    items = read_items(sorted((tuple(r) for r in queries.collect()), key=str))
    if not items.ids:
        return spark.createDataFrame([], PAIRS)
    kind = "<i2" if len(items.vocabulary) < 1 << 15 else "<i4"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias(KEY), "text")
    encoded = scratch.save(encode(keyed, items))
    df, passages = frequencies(encoded, kind, len(items.vocabulary))
    weight = weigh(items, df, passages)
    vectors = space(sketch(encoded, kind, weight, rank), weight)
    found = None
    for block in items.blocks(block_bytes):
        new = scratch.save(search(encoded, kind, items, block, weight, vectors, df, cosine, share).distinct())
        found = new if found is None else found.unionByName(new)
    scratch.drop(encoded)
    return found


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    key = fresh(docs, KEY)
    bad = leaks(docs, benchmark).select(F.col(KEY).alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*[F.col(c) for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(KEY)
