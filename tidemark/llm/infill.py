r"""Operator 11: fill-in-the-middle, with a document's units as rows.

A unit is a match of ``[A-Za-z]+|[^A-Za-z]``. Documents are dealt out once, by a key; all that follows stays there::

    blocks   posexplode of runs of ``RUN`` units; a window's running sum of their lengths tells where each begins
    requests the two cuts of a document, as ordinals of units, from its digest and its number of units
    cuts     requests joined with the block that holds the unit before the cut; that block's units are posexploded
             and the lengths of those before the cut are summed onto the block's start
    offsets  both cuts of a document in one row, joined with its text, which is cut by substring

Only the blocks that hold a cut become single units, so a document of m units is m / RUN + 2 RUN rows, none of which holds
more than a run's text. Rows equal in doc_id and text within a part of the input are one row with a count until the end, and the part
is in the key, so a document that holds a third of all rows is spread over the parts it came from.

The output is ``text`` (plain), ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm); the text
is rebuilt by splitting at the marks, which a formatted text doesn't hold.

Defined cases: a null or empty text is an empty plain one; a null doc_id is hashed as no digits; repeated rows give repeated
rows; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

RUN = 32
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Without giving anything back: a run of letters is one unit, so a block ends where the 32nd unit ends.
BLOCK = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{RUN}}}+"
#: Of values that are never null, so that plain equality joins what was dealt out once.
KEY = ["doc", "k1", "k2", "part"]
PLAIN_FROM, SPM_BELOW = 90, 20
MARKS = ("<P>", "<S>", "<M>")


def digits(name: str, n: int) -> Column:
    """The n-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(name, 8 * n - 7, 8), 16, 10).cast("long")


def grouped(docs: DataFrame) -> DataFrame:
    """One row for each key, with its text and number of copies; all later steps find a key's rows in one partition."""
    text = F.coalesce("text", F.lit(""))
    doc = F.col("doc_id").cast("long")
    part = F.spark_partition_id() * 2 + doc.isNull().cast("int")
    keyed = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), part.alias("part"))
    return keyed.repartition(*KEY).groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def planned(rows: DataFrame) -> DataFrame:
    """Adds n, the form and the cuts ``low`` and ``high``, in units."""
    sha = F.sha2(F.concat(F.lit("1:"), F.when(F.col("part") % 2 == 0, F.col("doc").cast("string")).otherwise("")), 256)
    n = F.regexp_count("text", F.lit(UNIT)).cast("long")
    plain = (F.col("text") == "") | (digits("sha", 3) % 100 >= PLAIN_FROM)
    for mark in MARKS:
        plain = plain | F.contains("text", F.lit(mark))
    told = rows.withColumn("sha", sha).withColumn("n", n)
    cut = [digits("sha", k) % (F.col("n") + 1) for k in (1, 2)]
    return told.select(
        *rows.columns,
        "n",
        F.when(plain, "plain").when(digits("sha", 4) % 100 < SPM_BELOW, "spm").otherwise("psm").alias("form"),
        F.least(*cut).alias("low"),
        F.greatest(*cut).alias("high"),
    )


def offsets(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, which, cut) to (key, low, high): the code points before each cut; a cut before the first unit has no row."""
    blocks = rows.select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0))).alias("b", "block"))
    before = Window.partitionBy(*KEY).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("start", F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)))
    on = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in KEY]
    taken = F.col("r.cut") - F.col("p.b") * RUN  # units of the block before the cut
    held = placed.alias("p").join(requests.alias("r").hint("merge"), [*on, taken.between(1, RUN)])
    held = held.select(*[F.col(f"r.{k}").alias(k) for k in KEY], "which", "start", taken.alias("taken"), "block")
    units = held.select(*KEY, "which", "start", "taken", F.posexplode(F.regexp_extract_all("block", F.lit(UNIT), F.lit(0))).alias("u", "unit"))
    lengths = F.when(F.col("u") == 0, F.col("start")).otherwise(0) + F.length("unit")
    return units.where("u < taken").groupBy(*KEY).agg(*[F.coalesce(F.sum(F.when(F.col("which") == w, lengths)), F.lit(0)).alias(f"{w}_chars") for w in ("low", "high")])


def infill(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n, form, prefix_chars, middle_chars, output)."""
    rows = grouped(docs)
    told = planned(rows)
    cuts = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(w).alias("cut")) for w in ("low", "high")]))
    requests = told.where("form <> 'plain'").select(*KEY, cuts.alias("c")).select(*KEY, "c.which", "c.cut").where("cut > 0")
    at = offsets(rows, requests)
    both = told.alias("d").join(at.alias("a").hint("merge"), KEY, "left")
    low, high = (F.coalesce(f"a.{w}_chars", F.lit(0)).cast("int") for w in ("low", "high"))
    cut = both.select(F.when(F.col("part") % 2 == 0, F.col("doc")).alias("doc_id"), "d.copies", "d.n", "d.form", "d.text", low.alias("low"), high.alias("high"))
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("low")), F.substring(text, F.col("low") + 1, F.col("high") - F.col("low")), F.substring(text, F.col("high") + 1, F.length(text))
    psm, spm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle), F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    moved = F.col("form") != "plain"
    out = cut.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("low").cast("long")).alias("prefix_chars"),
        F.when(moved, (F.col("high") - F.col("low")).cast("long")).alias("middle_chars"),
        F.when(~moved, text).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
        F.sequence(F.lit(1), F.col("copies")).alias("copies"),
    )
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", F.explode("copies").alias("copy")).drop("copy")


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form."""
    parts = F.split(output, "|".join(MARKS), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents
), planned AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM units
), cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high
  FROM planned
), parts AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
