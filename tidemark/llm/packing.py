"""Operator 5: packing token sequences into windows by minimum bin slack.

A document's ids are cut at the window's capacity; what is left of it is one piece. A histogram of piece lengths
(one row for each length up to the capacity, whatever the corpus) goes to the driver. There, again and again, the
largest remaining length is put in a window and a bitset subset-sum recurrence over the remaining lengths, with
their counts, finds the fullest reachable window; the counts are traced back from the bitsets and the pattern is
used as often as the counts allow. Pieces of a length are numbered without gaps over the cluster, and a piece's
number says which copy of which pattern holds it, so no task ever holds a window's rows or a length's rows.

Defined cases: a null or empty text has only the end id; repeated rows are packed as often as they come; rows with
a null doc_id are packed like any other; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_texts, numbered, resident, table

CAPACITY, END_ID = 4096, 2
KEPT_WORDS = 750_000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION = MARKS.encode()


class Numbers(dict):
    """Numbers new keys as they are asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts, looked up by word.

    The tokenizer lowers case, drops white space and never joins what white space parts, so a text's ids are those
    of its words in turn. Words are kept with their ids; above ``kept`` words only those
    that came again and again since the last time stay.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.flat, self.lens, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.hits = np.zeros(1 << 16, np.int32)
        self.known = self.used = 0

    def forget(self) -> None:
        """Keeps the words met most, a third of the table at most."""
        hits = self.hits[: self.known]
        least = max(2, int(np.partition(hits, -(self.kept // 3))[-(self.kept // 3)]) + 1)
        stay = np.flatnonzero(hits >= least)
        words = np.array(list(self.at), object)[stay]
        lens = self.lens[stay].astype(np.int64)
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[stay] - (ends - lens), lens) + np.arange(int(lens.sum()))]
        self.clear()
        for w in words:
            self.at[w]
        self.room()
        self.put(np.arange(len(stay)), ids, lens)
        self.known = len(stay)

    def room(self) -> None:
        while len(self.at) > len(self.lens):
            self.lens, self.starts, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.starts, self.hits))

    def put(self, rows: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lens[rows], self.starts[rows] = lens, self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self) -> None:
        """The ids of the words that have a number but none yet.

        A word that ends in punctuation after a letter or digit has the ids of its two parts, so each part is encoded
        once for all words that share it. Words of letters, and runs of punctuation, are encoded together: each is one
        unit, and a unit's last id says that it is.
        """
        split: list[tuple[int, int, int]] = []
        for n, w in enumerate(list(islice(self.at, self.known, None)), self.known):
            head = w.rstrip(PUNCTUATION)
            if head and len(head) < len(w) and (head[-1:].isalnum() or (head[-1] > 127 and head.decode("utf-8", "replace")[-1].lower()[-1:].isalpha())):
                split.append((n, self.at[head], self.at[w[len(head) :]]))
        self.room()
        new = np.ones(len(self.at), bool)
        new[: self.known] = False
        parts = np.array(split, np.int64).reshape(-1, 3)
        new[parts[:, 0]] = False
        words = [w.decode("utf-8", "replace") for w, own in zip(islice(self.at, self.known, None), new[self.known :].tolist(), strict=True) if own]
        numbers = np.flatnonzero(new)
        for k in range(0, len(words), 8192):
            part, rows = words[k : k + 8192], numbers[k : k + 8192]
            one = np.fromiter((w.isalpha() or not w.strip(MARKS) for w in part), bool, len(part))
            plain = np.flatnonzero(one)
            ids = np.array(self.tok.encode_batch_fast([" ".join(part[i] for i in plain)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(plain) and len(last) == len(plain):
                self.put(rows[plain], ids, np.diff(last, prepend=0))
                rest = np.flatnonzero(~one)
            else:
                rest = np.arange(len(part))
            own = [e.ids for e in self.tok.encode_batch_fast([part[i] for i in rest], add_special_tokens=False)]
            self.put(rows[rest], np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64))
        if len(parts):
            both = parts[:, 1:].reshape(-1)  # head and tail of each word in turn
            lens = self.lens[both].astype(np.int64)
            ends = np.cumsum(lens)
            ids = self.flat[np.repeat(self.starts[both] - (ends - lens), lens) + np.arange(int(ends[-1]))]
            self.put(parts[:, 0], ids, lens.reshape(-1, 2).sum(axis=1))
        self.known = len(self.at)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and each text's number of ids."""
        words = [t.lower().split() if t else [] for t in texts]  # of bytes: A-Z and ASCII white space only
        if self.known > self.kept:
            self.forget()
        flat = list(chain.from_iterable(words))
        idx = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        if len(self.at) > self.known:
            self.learn()
        self.hits[: self.known] += np.bincount(idx, minlength=self.known).astype(np.int32)
        lens = self.lens[idx].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[idx] - (ends - lens), lens) + np.arange(total)]
        bounds = np.cumsum([0, *map(len, words)])
        upto = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(upto)


def encoder(path: str) -> Encoder:
    return resident(f"encoder {path}", lambda: Encoder(path))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of the capacity."""

    def cut(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lens = encoder(tokenizer).encode(texts)
        rows: tuple[list, ...] = ([], [], [], [], [])
        end = np.array([end_id], np.uint32)
        at = 0
        for doc, n in zip(batch.column(0).to_pylist(), lens.tolist(), strict=True):
            own = np.concatenate([ids[at : at + n], end])
            at += n
            for a in range(0, n + 1, capacity):
                part = own[a : a + capacity]
                for col, v in zip(rows, (doc, a, len(part), zlib.crc32(part.astype("<u4").tobytes()), n + 1), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", cut, PIECES, most=2 << 20, keeps=True)


def fill(counts: dict[int, int], room: int, order: list[int]) -> dict[int, int]:
    """Counts of the lengths whose sum comes closest to ``room``; ``order`` holds the lengths, rising."""
    reach, mask, steps, full = 1, (1 << (room + 1)) - 1, [], 1 << room
    for k in range(bisect_right(order, room) - 1, -1, -1):
        length = order[k]
        left = min(counts[length], room // length)
        copies = 1
        while left and not reach & full:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (times used, counts by length) that use up ``counts``."""
    left = {k: v for k, v in counts.items() if v}
    order, out = sorted(left), []
    while order:
        largest = order[-1]
        left[largest] -= 1
        pattern = fill(left, capacity - largest, order)
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        out.append((times, pattern))
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                order.remove(k)
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first number of each run of pieces, the pieces a window takes, the offset of the first and
    the first window."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    window = 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            c = pattern[length]
            runs.setdefault(length, []).append((given.get(length, 0), c, offset, window))
            given[length] = given.get(length, 0) + times * c
            offset += c * length
        window += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to one row per piece with its sequence and its offset there."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, tokenizer, capacity, end_id))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    at = places(plan(counts, capacity))
    numbers = numbered(cut, scratch, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "number", rows=sum(counts.values()))

    def put(it):
        for batch in it:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                n = int(length[rows[0]])
                first, each, offset, window = at[n]
                k = np.searchsorted(first, number[rows], "right") - 1
                within = number[rows] - first[k]
                seq[rows] = window[k] + within // each[k]
                off[rows] = offset[k] + within % each[k] * n
            cols = [batch.column(i) for i in range(5)] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return numbers.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "number").mapInArrow(put, PIECES + ", sequence_id long, offset long")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
