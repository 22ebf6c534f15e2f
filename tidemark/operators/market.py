"""Prices as context: returns as of a date, volatility, excess over a benchmark. They never feed a score.

Rows are (symbol, date, close); returns are aggregates with a filter and need no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPANS = {"ret_1m": 30, "ret_3m": 91, "ret_6m": 182}


def returns(prices: DataFrame, end: str, spans: dict[str, int] | None = None) -> DataFrame:
    """The return of each symbol over so many days before its last close at or before ``end``: the base is the last
    close at or before that day, null without one."""
    spans = spans or SPANS
    rows = prices.where(F.col("date") <= F.lit(end).cast("date"))
    last = rows.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"), F.count(F.lit(1)).alias("n"))
    met = rows.join(last, "symbol")
    base = [F.max_by("close", F.when(F.datediff("last_date", "date") >= d, F.col("date"))).alias(k) for k, d in spans.items()]
    out = met.groupBy("symbol", "last_date", "last_close", "n").agg(*base)
    return out.select("symbol", "last_date", *[F.when(F.col("n") >= 2, F.col("last_close") / F.col(k) - 1).alias(k) for k in spans])


def volatility(prices: DataFrame) -> DataFrame:
    """Yearly volatility of log returns; null below three closes or two returns."""
    w = Window.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(w)
    rows = prices.withColumn("ret", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("n_ret"), F.stddev_samp("ret").alias("sd"))
    return out.select("symbol", F.when((F.col("n") >= 3) & (F.col("n_ret") >= 2), F.col("sd") * F.sqrt(F.lit(252.0))).alias("realised_vol"))


def quadrant(sentiment: Column, excess: Column) -> Column:
    return (
        F.when(sentiment.isNull() | excess.isNull(), "n/a")
        .when(sentiment < 0, F.when(excess < 0, "negative & underperformed: priced-in").otherwise("negative & not sold off: potential unpriced risk"))
        .when(sentiment > 0, F.when(excess > 0, "positive & outperformed: confirmed").otherwise("positive & lagging: not yet reflected"))
        .otherwise("neutral sentiment")
    )


def context(prices: DataFrame, benchmark: DataFrame, sentiment: DataFrame, end: str) -> DataFrame:
    """Returns, volatility and the excess over the benchmark's one-month return, with the quadrant of both signs."""
    bench = returns(benchmark, end, {"bench_1m": 30}).select("bench_1m")
    out = returns(prices, end).join(volatility(prices), "symbol").join(F.broadcast(bench)).join(sentiment.select("symbol", "sentiment"), "symbol", "left")
    out = out.withColumn("excess_1m", F.col("ret_1m") - F.col("bench_1m"))
    return out.withColumn("quadrant", quadrant(F.col("sentiment"), F.col("excess_1m")))
