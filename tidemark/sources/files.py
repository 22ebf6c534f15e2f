"""File scans: portfolios, pasted tables, items, actions, prices, verified evidence, golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.timing import as_date

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "snippet", "url", "date", "source")])
ACTION = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "title", "url", "date", "materiality", "direction")])
HOLDING = ("symbol", "name", "sector", "cap", "weight", "aliases", "isin", "bse_code")


def portfolio(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with symbol, name and sector, in any case and order; other known columns if there; rows without a symbol
    are skipped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.strip().lstrip("﻿").lower() for c in raw.columns])
    missing = [c for c in HOLDING[:3] if c not in raw.columns]
    if missing:
        raise ValueError(f"portfolio lacks {', '.join(missing)}")
    cols = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in raw.columns else F.lit("").alias(c) for c in HOLDING]
    return raw.select(*cols).where("symbol <> ''")


def pasted(spark: SparkSession, path: str) -> DataFrame:
    """Lines with tabs or two spaces between cells: a symbol (exchange prefix dropped), a name and perhaps an ISIN.
    The first line of a symbol counts; a header line is passed over."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    cells = F.filter(F.transform(F.split(F.trim("value"), r"\t|\s{2,}"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.select("n", cells.alias("c")).where(F.size("c") >= 2)
    symbol = F.upper(F.regexp_replace(F.element_at("c", 1), r"(?i)^(NSE|BSE)\s*:\s*", ""))
    isin = F.get(F.filter("c", lambda x: x.rlike("^IN[A-Z0-9]{10}$")), 0)
    name = F.get(F.filter(F.slice("c", 2, 99), lambda x: x.rlike("[A-Za-z]{2}") & ~x.rlike("^IN[A-Z0-9]{10}$")), F.size(F.filter(F.slice("c", 2, 99), lambda x: x.rlike("[A-Za-z]{2}") & ~x.rlike("^IN[A-Z0-9]{10}$"))) - 1)
    rows = rows.select("n", symbol.alias("symbol"), clean_suffix(F.coalesce(name, F.lit(""))).alias("name"), isin.alias("isin"))
    rows = rows.where("symbol rlike '^[A-Z0-9&-]+$' and not symbol rlike '(?i)symbol'")
    return rows.groupBy("symbol").agg(F.min_by(F.struct("name", "isin"), "n").alias("x")).select("symbol", "x.*")


def clean_suffix(name: Column) -> Column:
    """A company's name without its legal form."""
    return F.trim(F.regexp_replace(name, r"(?i)[ ,]+(ltd|limited)\.?$", ""))


def enriched(holdings: DataFrame, universe: DataFrame) -> DataFrame:
    """Holdings with empty cells filled from the universe, and a sector in any case."""
    u = universe.select(F.upper("symbol").alias("__k"), *[F.col(c).alias(f"__{c}") for c in HOLDING[1:] if c in universe.columns])
    out = holdings.join(u, F.upper(holdings.symbol) == F.col("__k"), "left")
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"__{c}"), F.lit("")) if f"__{c}" in u.columns else F.lit(None))
    cols = [F.coalesce(fill(c), F.lit("Unclassified" if c == "sector" else "")).alias(c) for c in HOLDING[1:] if c in holdings.columns]
    return out.select("symbol", *cols)


def find_holdings(query: str, universe: DataFrame) -> DataFrame:
    """Rows whose symbol, name or alias is the query, else those that hold it or are held in it; a caller who needs one
    asks for exactly one row. The query is one value, so this is a filter."""
    q = "".join(c if c.isalnum() else " " for c in query.lower())
    q = " ".join(q.split())
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = F.concat(F.array(plain(F.col("symbol")), plain(F.col("name"))), F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), plain))
    names = F.filter(names, lambda x: x != "")
    rows = universe.withColumn("__exact", F.array_contains(names, q)).withColumn("__near", F.exists(names, lambda x: F.contains(x, F.lit(q)) | F.contains(F.lit(q), x)))
    return rows.withColumn("__any", F.max("__exact").over(Window.partitionBy())).where(F.col("__exact") | (~F.col("__any") & F.col("__near"))).drop("__exact", "__near", "__any")


def items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists of items by symbol. Dates aren't filtered here: the validator gives late rows a reason."""
    raw = spark.read.option("wholetext", True).text(path)
    by = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(ITEM)))
    rows = raw.select(F.explode(by).alias("symbol", "rows")).select("symbol", F.posexplode("rows").alias("pos", "x"))
    return rows.select("symbol", "pos", "x.title", "x.snippet", F.coalesce("x.url", F.lit("")).alias("url"), F.col("x.date").alias("published_raw"), as_date(F.col("x.date")).alias("published"), "x.source", F.lit("news").alias("kind"))


def action_items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists of actions by symbol, which bring their labels."""
    raw = spark.read.option("wholetext", True).text(path)
    by = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(ACTION)))
    rows = raw.select(F.explode(by).alias("symbol", "rows")).select("symbol", F.posexplode("rows").alias("pos", "x"))
    sign = F.when(F.col("x.direction") == "positive", 1).when(F.col("x.direction") == "negative", -1).otherwise(0)
    return rows.select("symbol", "pos", "x.title", F.coalesce("x.url", F.lit("")).alias("url"), as_date(F.col("x.date")).alias("published"), F.lit("action").alias("kind"), F.col("x.type").alias("event_type"), sign.alias("sentiment"), F.coalesce("x.materiality", F.lit("medium")).alias("materiality"))


def prices(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    out = spark.read.option("header", True).schema("date date, symbol string, close double").csv(path)
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


VERIFIED = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "symbol date headline event_type sentiment subject severity action_stage people_direction role_tier amount_inr_cr event_key "
            "penalty_override status valid_as_of source_ref url note standing"
        ).split()
    ]
)


def verified(spark: SparkSession, path: str, as_of: str, lookback_days: int, symbols: DataFrame) -> DataFrame:
    """Verified evidence with a reason for rows that aren't applied: dated rows count within the lookback, rows in force
    (without a date) at their own date only, unless they stand or are conventions."""
    raw = spark.read.option("header", True).schema(VERIFIED).csv(path)
    rows = raw.join(F.broadcast(symbols.select("symbol").distinct()), "symbol", "left_semi")
    day, own, at = as_date(F.col("date")), as_date(F.col("valid_as_of")), F.lit(as_of).cast("date")
    stands = F.lower(F.coalesce("standing", F.lit(""))).isin("yes", "true", "1", "y") | (F.lower(F.coalesce("status", F.lit(""))) == "convention")
    why = (
        F.when(day > at, "dated after the run")
        .when(day < F.date_sub(at, lookback_days), "outside the lookback")
        .when(day.isNull() & ~stands & ~F.coalesce(own == at, F.lit(False)), "in force at another date")
    )
    num = lambda c: F.try_to_number(F.nullif(F.col(c), F.lit("")), F.lit("S99999.99")).cast("double")
    return rows.select("*", F.coalesce(day, at).alias("published"), num("penalty_override").alias("override"), num("amount_inr_cr").alias("amount"), why.alias("skipped"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that start with # are comments. All values are strings but the label, which is a struct."""
    label = "struct<event_type:string,subject:string,occurred_at_company:boolean,action_stage:string,severity:string,amount_inr_cr:double,people_direction:string,role_tier:string,event_key:string>"
    schema = f"id string, symbol string, headline string, snippet string, published_date string, expected string, expected_weight double, label {label}"
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(F.from_json("value", schema).alias("x")).select("x.*")
    return rows.select("id", "symbol", F.col("headline").alias("title"), F.lit("").alias("rationale"), as_date(F.col("published_date")).alias("published"), "expected", "expected_weight", "label.*")
