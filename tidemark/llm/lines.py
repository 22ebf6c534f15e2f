"""Operator 9: repeated runs of lines, found by winnowing over line hashes.

Lines are compared with their white space made single spaces; blank lines are passed over. A run counts if it has
``min_lines`` lines or ``min_words`` words. A window starts at each line and goes on until it is such a run, so every
run that counts holds the window of its first line, and two equal runs hold equal windows. In each window the line with
the smallest hash (the last of equal ones) is selected: equal windows select the same line, so two equal runs share a
selected line at the same place, the guaranteed fingerprint.

Only selected lines, as (hash, document, place), are dealt over the cluster. Those whose hash stands once are dropped;
the others are joined back to their places, where matches are extended line by line both ways: a run of up to
``min_lines`` lines that holds the place and counts is named by the digest of its lines, for each number of lines before
and after the place. All but the first of equal runs, in the order of (doc_id, text's hash, place), are repeats; an
aggregate finds the first, so a line that every document holds costs as many rows as it has places and no pairs.
A run that is found again in its own document may overlap what it repeats (lines that recur with a period): the lines of
such a first copy stay, so it is kept whole, and the lines after it go. Of a run whose first copy is in another document
every line goes.
Overlapping repeats join to maximal repeated runs: each line of a maximal run lies in a run of at most ``min_lines``
lines in it that counts and holds a guaranteed fingerprint, so the whole run goes and nothing else does. Other lines
stay as they were.

Hashes and digests that hold a thousandth of all rows, a thousand at most, are told apart from the others and joined by
a broadcast; so no task gets a hot one's rows.

Defined cases: a null text stays null and an empty one empty; a document in which no run counts is left alone; rows
equal in doc_id and text count as one occurrence, and each is cleaned alike; an empty table gives no rows; columns
other than text (and n_chars in the pipeline) are kept, whatever their names; n_lines and n_removed replace columns so
named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_texts, split_join, table

MIN_LINES, MIN_WORDS = 3, 50
WIDTH = 16  # bytes of a line's hash


def content(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """The lines that are not blank, in single spaces, with their numbers of words and places in the text."""
    lines, words, places = [], [], []
    for k, raw in enumerate(text.split(b"\n")):
        own = raw.split()
        if own:
            lines.append(b" ".join(own))
            words.append(len(own))
            places.append(k)
    return lines, words, places


def windows(words: list[int], min_lines: int, min_words: int) -> list[int]:
    """The number of lines of the window that starts at each line; 0 where the text ends first."""
    out = []
    for k in range(len(words)):
        total = n = 0
        for w in words[k : k + min_lines]:
            total, n = total + w, n + 1
            if total >= min_words or n == min_lines:
                out.append(n)
                break
        else:
            out.append(0)
    return out


def selected(hashes: list[int], sizes: list[int]) -> list[int]:
    """The places of the windows' smallest hashes, the last of equal ones."""
    return sorted({min(range(k, k + n), key=lambda i: (hashes[i], -i)) for k, n in enumerate(sizes) if n})


def runs(words: list[int], places: list[int], min_lines: int, min_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the runs of up to ``min_lines`` lines that count and hold one of ``places``."""
    out = set()
    for at in places:
        for before in range(min(at, min_lines - 1) + 1):
            first = at - before
            total = sum(words[first:at])
            for n in range(before + 1, min(min_lines, len(words) - first) + 1):
                total += words[first + n - 1]
                if n == min_lines or total >= min_words:
                    out.add((first, n))
    return sorted(out)


HASHED = "doc_id long, row long, hashes binary, words array<int>, selected array<struct<fp:long,at:int>>"
RUNS = "digest binary, doc_id long, row long, at int, n int"


def hashed(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, row, text) to the lines' hashes and numbers of words and the selected lines, where a run counts."""

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, held, sizes, marks = [], [], [], []
        for k, text in enumerate(texts):
            lines, words, _ = content(text or b"")
            if len(words) < min_lines and sum(words) < min_words:
                continue
            digests = [xxhash.xxh3_128_digest(x) for x in lines]
            fps = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            rows.append(k)
            held.append(b"".join(digests))
            sizes.append(words)
            marks.append([{"fp": fps[i], "at": i} for i in selected(fps, windows(words, min_lines, min_words))])
        take = pa.array(rows, pa.int64())
        kind = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32())]))
        cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(held, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(marks, kind)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "hashes", "words", "selected"])

    return map_texts(docs, "text", work, HASHED)


def extended(matched: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, row, hashes, words, places) to the runs around the places with their digests."""

    def work(it):
        for batch in it:
            digests, ids, rows, firsts, sizes = [], [], [], [], []
            for doc, row, raw, words, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for first, n in runs(words, places, min_lines, min_words):
                    digests.append(xxhash.xxh3_128_digest(raw[WIDTH * first : WIDTH * (first + n)]))
                    ids.append(doc)
                    rows.append(row)
                    firsts.append(first)
                    sizes.append(n)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((digests, ids, rows, firsts, sizes), kinds, strict=True)], ["digest", "doc_id", "row", "at", "n"])

    return matched.select("doc_id", "row", "hashes", "words", "places").mapInArrow(work, RUNS)


def repeats(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, text) to (row, runs): the repeated runs as (first line, lines, first line of the first copy where
    the same document holds it)."""
    lines = scratch.save(hashed(docs, min_lines, min_words))
    marks = lines.select("row", F.inline("selected"))
    counts = scratch.save(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("count")).where("count > 1"))
    met = split_join(marks, counts, "fp", "left_semi").groupBy("row").agg(F.collect_set("at").alias("places"))
    matched = scratch.save(extended(lines.join(met.hint("merge"), "row"), min_lines, min_words))
    order = F.struct(F.col("doc_id"), F.col("row"), F.col("at"))
    first = scratch.save(matched.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1"))
    later = split_join(matched, first, "digest", "inner").where(~F.col("first").eqNullSafe(order))
    own = F.when((F.col("first.row") == F.col("row")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")), F.col("first.at"))
    return later.groupBy("row").agg(F.collect_set(F.struct("at", "n", own.alias("of"))).alias("runs"))


def deleted(found: list[dict]) -> set[int]:
    """The lines that go, by their numbers among those that are not blank."""
    lines = lambda key, own: {i for w in found if (w["of"] is not None) == own for i in range(w[key], w[key] + w["n"])}
    return lines("at", False) | (lines("at", True) - lines("of", True))


def clean(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from text, and n_lines and n_removed, the counts of lines that are
    not blank. A text of which lines were deleted is joined again from its other lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = scratch.save(repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text"), scratch, min_lines, min_words))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, runs_ = fresh(docs, "__row"), fresh(docs, "__runs")
    # always by a shuffle: whether repeats are few enough to broadcast depends on the corpus
    found = found.select(F.col("row").alias(key), F.col("runs").alias(runs_))
    joined = docs.withColumn(key, row).join(found.hint("merge"), key, "left").select(*[F.col(c) for c in names], runs_)
    at = names.index("text")

    def work(texts: list[bytes | None], batch: pa.RecordBatch) -> pa.RecordBatch:
        out, total, removed = [], [], []
        for text, gone in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
            if text is None:
                out.append(None)
                total.append(0)
                removed.append(0)
                continue
            _, _, places = content(text)
            total.append(len(places))
            if gone:
                dead = {places[i] for i in deleted(gone)}
                text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in dead)
                removed.append(len(dead))
            else:
                removed.append(0)
            out.append(text)
        cols = [batch.column(k) for k in range(len(names))]
        cols[at] = pa.array(out, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in names)
    return map_texts(joined, "text", work, f"{kinds}, n_lines long, n_removed long")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All runs of one to three lines that count, as in MIN_LINES and MIN_WORDS.
CLEANED_SQL = r"""
raw_lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS raw, unnest(l) AS line
  FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM {docs} WHERE text IS NOT NULL)
), shown AS (
  SELECT doc_id, raw, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM raw_lines
), placed AS (
  SELECT *, row_number() OVER w AS pos, length(plain) - length(replace(plain, ' ', '')) + 1 AS words FROM shown WHERE plain <> ''
  WINDOW w AS (PARTITION BY doc_id ORDER BY raw)
), ahead AS (
  SELECT *, lead(plain, 1) OVER w AS p1, lead(plain, 2) OVER w AS p2, lead(words, 1) OVER w AS w1 FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY raw)
), windowed AS (
  SELECT doc_id, pos, 1 AS n, plain AS body FROM ahead WHERE words >= 50
  UNION ALL SELECT doc_id, pos, 2, plain || chr(10) || p1 FROM ahead WHERE words + w1 >= 50
  UNION ALL SELECT doc_id, pos, 3, plain || chr(10) || p1 || chr(10) || p2 FROM ahead WHERE p2 IS NOT NULL
), repeated AS (
  SELECT doc_id, pos, n, first_value(doc_id) OVER w AS of_doc, first_value(pos) OVER w AS of_pos FROM windowed
  WINDOW w AS (PARTITION BY body ORDER BY doc_id, pos) QUALIFY row_number() OVER w > 1
), dead AS (
  SELECT doc_id, pos + k AS pos FROM repeated, unnest(range(n)) AS t(k) WHERE of_doc <> doc_id
  UNION (SELECT doc_id, pos + k FROM repeated, unnest(range(n)) AS t(k) WHERE of_doc = doc_id EXCEPT SELECT doc_id, of_pos + k FROM repeated, unnest(range(n)) AS t(k) WHERE of_doc = doc_id)
), gone AS (
  SELECT p.doc_id, p.raw FROM placed p JOIN dead d USING (doc_id, pos)
), joined AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.raw) FILTER (g.raw IS NULL) AS text,
    count(*) FILTER (s.plain <> '') AS n_lines, count(g.raw) AS n_removed
  FROM shown s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.raw = g.raw GROUP BY s.doc_id
), cleaned AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
    coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
  FROM {docs} d LEFT JOIN joined j USING (doc_id)
)"""
OP9_SQL = "WITH " + CLEANED_SQL.format(docs="documents", text="text") + " SELECT doc_id, text, n_lines, n_removed FROM cleaned"
