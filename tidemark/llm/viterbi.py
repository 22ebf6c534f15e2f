"""Operator 2: token counts of a unigram tokenizer, without its tokens.

The tokenizer is the unigram model of the ``tokenizers`` library over the pieces and scores of a sentencepiece file,
with its Metaspace pre-tokenizer and byte fallback. White space parts a text into words that start with its mark, and
a word's count depends on the word alone, so counts are kept by word in a bounded table. For a new word an
Aho-Corasick automaton lists all pieces that end at each character, the longest first; a recurrence over the ends
carries the best score and the pieces it took.

Tie rules, as the tokenizer has them: a later start replaces the best one only with a greater score, so the longest of
equally good last pieces stays; a character that is no piece itself may be taken alone, at the least score of the
vocabulary less 10, after all pieces that end there, and counts as many pieces as it has bytes.

Defined cases: a null or empty text has no tokens; rows are counted each; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, resident, table

MARK, PENALTY, KEPT_WORDS, KEPT_LENGTH = "▁", 10.0, 600_000, 80


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], kept: int = KEPT_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.score: dict[str, float] = {}
        for p, s in pieces:
            self.score[p] = s  # the last of equal pieces, as in the tokenizer's table
        for p, s in self.score.items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        #: A line break that no longer piece holds parts a word too.
        self.apart = not any("\n" in p and p != "\n" for p in self.score)
        self.kept = kept
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done, alone = 0, False  # the end that is being filled, and whether a piece of one character was found
        top: float | None = None
        took = 0

        def close(end: int) -> None:
            nonlocal top, took, alone
            if not alone:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, took = s, pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = top, took
            top, took, alone = None, 0, False

        for last, (length, score) in self.automaton.iter(word):
            while done < last:
                done += 1
                close(done)
            s = best[last + 1 - length] + score
            if top is None or s > top:
                top, took = s, pieces[last + 1 - length] + 1
            if length == 1:
                alone = True
        while done < n:
            done += 1
            close(done)
        return pieces[n]

    def words(self, text: str) -> list[str]:
        t = text.replace(" ", MARK)
        if not t:
            return []
        if t[0] != MARK:
            t = MARK + t
        parts = [MARK + p for p in t.split(MARK)[1:]]
        if self.apart and "\n" in t:
            parts = [x for p in parts for x in (self.lines(p) if "\n" in p else (p,))]
        return parts

    @staticmethod
    def lines(part: str) -> list[str]:
        out = []
        for k, x in enumerate(part.split("\n")):
            if k:
                out.append("\n")
            if x:
                out.append(x)
        return out

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        words = [self.words(t.decode("utf-8", "replace")) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        new = set(flat).difference(self.known)
        if len(self.known) + len(new) > self.kept:
            self.known = {}
            new = set(flat)
        long = {}
        for w in new:
            (self.known if len(w) <= KEPT_LENGTH else long)[w] = self.count(w)
        if long:
            get = self.known.get
            n = np.fromiter((long[w] if (c := get(w)) is None else c for w in flat), np.int64, len(flat))
        else:
            n = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, words)])])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens)."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = resident(f"counter {path}", lambda: Counter(vocabulary(path)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(texts))], ["doc_id", "n_tokens"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", work, "doc_id long, n_tokens long", keeps=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
