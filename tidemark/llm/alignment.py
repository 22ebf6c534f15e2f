"""Operator 12: tokens of two tokenizers aligned by a transducer over dangling suffixes.

Both token streams spell the same bytes. The transducer's state is the side that leads and the bytes by which it leads;
the side that lags gives the next token, and the state after it depends on the residual and that token alone, so moves
are kept. An empty residual closes a group: there a token of either side ends at the same byte, which is a link.

Neither tokenizer joins a space or line break to a character other than white space before it (checked on the vocabulary;
else texts are taken whole). So texts are cut there into units, the moves are made once for each new unit, and a bounded
table keeps a unit's groups. A text of which any unit spells other bytes than its own is encoded and compared whole.

Link counts are summed by slice of documents first. A slice has a pair once, so no pair holds more rows than there are
slices, and only a slice's own pairs come back to it. No row holds more than ``PART`` links: readers and writers take
thousands of rows at a time, which would be gigabytes of whole slices.

Defined cases: a null or empty text, and one that a tokenizer doesn't spell byte for byte (it holds U+2581), has no
tokens: zeros and an empty digest; repeated rows count each; a null doc_id stays null; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, map_texts, resident, table

MARK = "▁"
KEPT_UNITS, KEPT_MOVES, SLICE = 400_000, 1_000_000, 2 << 20
TOGETHER, PART = 512, 4096  # units encoded at once, and links in a row
#: A unit begins at a space or line break after a character that isn't white space.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_level() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Mismatch(Exception):
    """The two streams spell different bytes."""


class Transducer:
    def __init__(self, a: list[bytes], b: list[bytes], kept: int = KEPT_MOVES):
        self.a, self.b, self.kept = a, b, kept
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # 1: A leads, 2: B leads
        self.number = {(0, b""): 0}
        self.side = [0]
        self.moves: list[dict[int, int]] = [{}]
        self.made = 0

    def move(self, state: int, token: int) -> int:
        """The state after the lagging side's token (A's, where neither leads)."""
        side, rest = self.states[state]
        got = self.b[token] if side == 1 else self.a[token]
        if rest.startswith(got):
            to = (side, rest[len(got) :])
        elif got.startswith(rest):
            to = (2 if side == 1 else 1, got[len(rest) :])
        else:
            raise Mismatch
        if not to[1]:
            to = (0, b"")
        k = self.number.get(to)
        if k is None:
            k = self.number[to] = len(self.states)
            self.states.append(to)
            self.side.append(to[0])
            self.moves.append({})
        self.moves[state][token] = k
        self.made += 1
        return k

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """For each group, the number of A's and B's tokens up to its end."""
        if self.made > self.kept:
            self.clear()
        moves, side, out = self.moves, self.side, []
        i = j = state = 0
        n, m = len(a), len(b)
        while True:
            if side[state] == 1:
                if j == m:
                    raise Mismatch
                token = b[j]
                j += 1
            elif i < n:
                token = a[i]
                i += 1
            elif state or j < m:
                raise Mismatch
            else:
                return out
            k = moves[state].get(token)
            state = self.move(state, token) if k is None else k
            if not state:
                out.append((i, j))


class Aligner:
    """Tokens, groups and links of texts, by unit."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(a_path)
        self.tok.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        at, vocab = byte_level(), self.tok.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.a_bytes[i] = bytes(at[c] for c in s) if all(c in at for c in s) else s.encode()
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        pre = json.loads(self.tok.to_str())["pre_tokenizer"] or {}
        #: Whether units can be encoded apart: the published byte-level rule, and no piece that crosses a unit's start.
        self.apart = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.kept = kept
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str | None] = []  # the groups written out; None where A and B spell different bytes
        self.sizes = array("q")  # of each unit: tokens of A, of B, groups
        self.links = array("q")  # of all units in turn, one for each group
        self.odd: set[int] = set()  # units without a text

    def encode_a(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def aligned(self, a: list[int], b: list[int]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        """The groups written out, the tokens up to each group's end, and the links."""
        ends = self.transducer.groups(a, b)
        left, right = list(map(str, a)), list(map(str, b))
        parts, i, j = [], 0, 0
        for k, m in ends:
            if k - i == 1 == m - j:
                parts.append(f"{left[i]}|{right[j]}")
            else:
                parts.append(f"{','.join(left[i:k])}|{','.join(right[j:m])}")
            i, j = k, m
        at = np.array(ends, np.int64).reshape(-1, 2) - 1
        return parts, ends, np.array(a, np.int64)[at[:, 0]] << 32 | np.array(b, np.int64)[at[:, 1]]

    def put(self, unit: str, text: str | None, size: tuple[int, int, int]) -> None:
        k = self.known[unit] = len(self.texts)
        self.texts.append(text)
        self.sizes.extend(size)
        if text is None:
            self.odd.add(k)

    def put_apart(self, unit: str) -> None:
        a, b = self.encode_a(" a" + unit)[1:], self.sp.encode("a" + unit)[1:]
        try:
            if sum(map(len, (self.b_bytes[x] for x in b))) != len(unit.encode()):
                raise Mismatch
            parts, _, links = self.aligned(a, b)
        except Mismatch:
            self.put(unit, None, (0, 0, 0))
        else:
            self.links.frombytes(links.tobytes())
            self.put(unit, ";".join(parts), (len(a), len(b), len(parts)))

    def put_together(self, units: list[str]) -> None:
        """Units that both sides spell in one row, if each ends with a token of either side; none otherwise."""
        joined = "".join(units)
        a, b = self.encode_a(" a" + joined)[1:], self.sp.encode("a" + joined)[1:]
        ends = np.cumsum([len(u.encode()) for u in units])
        for ids, lens in ((a, self.a_len), (b, self.b_len)):
            upto = np.cumsum(lens[ids])
            if not len(upto) or upto[-1] != ends[-1] or not (upto[np.searchsorted(upto, ends)] == ends).all():
                return
        try:
            parts, groups, links = self.aligned(a, b)
        except Mismatch:
            return
        self.links.frombytes(links.tobytes())
        at = np.array(groups, np.int64)
        # a unit's end is a group's end
        last = np.searchsorted(np.cumsum(self.a_len[a])[at[:, 0] - 1], ends) + 1
        sizes = np.diff(np.column_stack([at[last - 1], last]), axis=0, prepend=0).tolist()
        g = 0
        for u, size in zip(units, sizes, strict=True):
            self.put(u, ";".join(parts[g : g + size[2]]), size)
            g += size[2]

    def learn(self, units: list[str]) -> None:
        """Encodes new units: those that end in no white space together, behind a first unit that is left out."""
        plain = [u for u in units if not u[-1].isspace() and MARK not in u]
        for k in range(0, len(plain), TOGETHER):
            self.put_together(plain[k : k + TOGETHER])
        for u in units:
            if u not in self.known:
                self.put_apart(u)

    def whole(self, text: str) -> tuple[str, tuple[int, int, int], np.ndarray]:
        """The text without cuts; nothing where its bytes differ."""
        a, b = self.encode_a(" " + text), self.sp.encode(text)
        want = (" " + text).encode()
        if b"".join(self.a_bytes[x] for x in a) == want == b"".join(self.b_bytes[x] for x in b):
            parts, _, links = self.aligned(a, b)
            return ";".join(parts), (len(a), len(b), len(parts)), links
        return "", (0, 0, 0), np.zeros(0, np.int64)

    def slice(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each text: its sizes and digest; the links of all texts in turn."""
        strings = [t.decode("utf-8", "replace") if t else "" for t in texts]
        units = [UNIT.findall(" " + s) if s and self.apart else [] for s in strings]
        new = set(chain.from_iterable(units)).difference(self.known)
        if len(self.known) + len(new) > self.kept:
            self.clear()
            new = set(chain.from_iterable(units))
        self.learn(sorted(new))
        digests, ats, bounds, whole = [], [], [0], {}
        for k, (s, own) in enumerate(zip(strings, units, strict=True)):
            at = [self.known[u] for u in own]
            if not s:
                text = ""
            elif not own or (self.odd and not self.odd.isdisjoint(at)):
                text, *whole[k] = self.whole(s)
            else:
                text = ";".join([self.texts[i] for i in at])
                ats += at
            bounds.append(len(ats))
            digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        of_unit, kept = np.array(self.sizes, np.int64).reshape(-1, 3), np.array(self.links, np.int64)
        starts = np.cumsum(of_unit[:, 2]) - of_unit[:, 2]
        at = np.array(ats, np.int64)
        n = of_unit[at, 2]
        links = kept[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        sizes = np.diff(np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(of_unit[at], axis=0)])[bounds], axis=0)
        if whole:
            pieces, done, upto = [], 0, np.cumsum(sizes[:, 2])
            for k, (size, more) in whole.items():
                pieces += [links[done : upto[k]], more]
                done, sizes[k] = upto[k], size
            links = np.concatenate([*pieces, links[done:]])
        return sizes, digests, links


SLICED = "slice long, at long, part int, doc_id long, n_a long, n_b long, n_groups long, digest string, places binary, pair long, n long"
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def batch(schema: str, cols: dict[str, object], rows: int) -> pa.RecordBatch:
    """A batch of the schema's columns; those that aren't given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], kinds[t]) if c in cols else pa.nulls(rows, kinds[t]) for c, t in names], [c for c, _ in names])


def sliced(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of slices of documents: one for each ``PART`` links of a document (at: its number in the slice), with the
    places of their pairs among the slice's, and one for each pair (at: its place) with its count. The places are of two
    bytes each in slices of up to 65,536 pairs."""
    made = [0]

    def work(texts: list[bytes | None], given: pa.RecordBatch) -> pa.RecordBatch:
        aligner = resident(f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        sizes, digests, links = aligner.slice(texts)
        pairs, places, counts = np.unique(links, return_inverse=True, return_counts=True)
        number = TaskContext.get().partitionId() << 32 | made[0]
        made[0] += 1
        places = places.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
        parts = np.maximum(-(-sizes[:, 2] // PART), 1)
        at = np.repeat(np.arange(len(texts)), parts)
        part = np.arange(len(at)) - (np.cumsum(parts) - parts)[at]
        start = (np.cumsum(sizes[:, 2]) - sizes[:, 2])[at] + part * PART
        stop = np.minimum(start + PART, np.cumsum(sizes[:, 2])[at])
        raw = [places[i:j].tobytes() for i, j in zip(start.tolist(), stop.tolist(), strict=True)]
        ids = given.column(0).take(pa.array(at))
        told = {"n_a": sizes[at, 0], "n_b": sizes[at, 1], "n_groups": sizes[at, 2], "digest": pa.array(digests, pa.string()).take(pa.array(at))}
        a = batch(SLICED, {"slice": np.full(len(at), number), "at": at, "part": part, "doc_id": ids, **told, "places": raw}, len(at))
        b = batch(SLICED, {"slice": np.full(len(pairs), number), "at": np.arange(len(pairs)), "pair": pairs, "n": counts}, len(pairs))
        return pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", work, SLICED, most=SLICE, keeps=True)


def link_counts(slices: DataFrame) -> DataFrame:
    """(pair, total, best): how often the corpus links the two ids, and whether no id of A is linked more often with that id of B."""
    totals = slices.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))  # as many rows as A has ids, at most
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(of_b)).alias("best"))


def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their links' sums, from (slice, at, part, total, best, places and a document's columns)
    sorted by slice, with a slice's pairs (part null) before its documents. One slice's pairs are held at a time."""
    held, pairs, values, open_ = None, [], None, None

    def done(x: list) -> pa.RecordBatch:
        d, n_a, n_b, n, digest = (list(c) for c in zip(*(r[0] for r in x), strict=True))
        return batch(ROWS, {"doc_id": d, "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "n_best": [r[1] for r in x], "count_sum": [r[2] for r in x], "groups_sha256": digest}, len(x))

    for b in it:
        col = {c: b.column(k) for k, c in enumerate(b.schema.names)}
        number = col["slice"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if number[i] != held:
                held, pairs, values = number[i], [], None
            own = {c: x.slice(i, j - i) for c, x in col.items()}
            m = own["part"].null_count
            if m:
                pairs.append([own["at"].slice(0, m).to_numpy(), own["total"].slice(0, m).to_numpy(), own["best"].slice(0, m).to_numpy(zero_copy_only=False)])
            if m == j - i:
                continue
            if values is None:
                at, total, best = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3
                values = np.zeros((2, len(at)), np.int64)
                values[:, at] = best, total
                pairs = []
            wide = values.shape[1] > 1 << 16
            raw = own["places"].slice(m).to_pylist()
            places = np.frombuffer(b"".join(raw), "<u4" if wide else "<u2")
            upto = np.concatenate([[0], np.cumsum([len(x) // (4 if wide else 2) for x in raw])])
            sums = np.diff(np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, places], axis=1)], axis=1)[:, upto], axis=1).tolist()
            told = zip(*(own[c].slice(m).to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups", "digest")), strict=True)
            for part, x, best, total in zip(own["part"].slice(m).to_pylist(), told, *sums, strict=True):
                if part:
                    open_[1] += best
                    open_[2] += total
                    continue
                if open_:
                    out.append(open_)
                open_ = [x, best, total]
        if out:
            yield done(out)
    if open_:
        yield done([open_])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, text) to one row per document: its tokens, groups and links, and what the corpus says of its links."""
    scratch = Scratch(docs.sparkSession, "alignment")
    slices = scratch.save(sliced(docs, a_path, b_path))
    counts = scratch.save(link_counts(slices))
    none = lambda kind: F.lit(None).cast(kind)
    told = slices.where("pair is not null").select("slice", "at", "pair").join(counts.hint("merge"), "pair")
    told = told.select("slice", "at", none("int").alias("part"), "total", "best", *[none(slices.schema[c].dataType).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "digest", "places")])
    own = slices.where("pair is null").select("slice", "at", "part", none("long").alias("total"), none("boolean").alias("best"), "doc_id", "n_a", "n_b", "n_groups", "digest", "places")
    both = own.unionByName(told).repartition("slice").sortWithinPartitions("slice", F.col("part").isNotNull(), "at", "part")
    return both.mapInArrow(summed, ROWS)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
