"""Sentiment: which rows count, weighted means, evidence standard, coverage, drivers.

Evidence rows have at least: symbol, kind, published, event_type, sentiment, substance, confidence, pass_, win.
Every aggregate is by symbol with partial sums before the shuffle; windows over a symbol are used only where a result
needs a row's share of its symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timing import event_weight
from ..plans.rubric import DEFAULT, Rubric


def is_evidence() -> Column:
    """News about the company itself and not only about its price."""
    return (F.col("kind") == "news") & (F.col("event_type") != "price_move") & (F.coalesce("substance", F.lit("primary")) != "passing")


def feeds_sentiment(r: Rubric = DEFAULT) -> Column:
    """Evidence that isn't a zero of a type that only administrates."""
    return is_evidence() & ~((F.col("sentiment") == 0) & F.col("event_type").isin(*r["sentiment"]["noise_zero_types"]))


def is_results(r: Rubric = DEFAULT) -> Column:
    return F.col("event_type").isin(*r["sentiment"]["results_event_types"]) | (F.coalesce("pass_", F.lit("")) == "results")


def feeds_action(r: Rubric = DEFAULT) -> Column:
    return (F.col("kind") == "news") & F.col("event_type").isin(*r["actions"]["severity"])


def band(mean: Column, r: Rubric = DEFAULT) -> Column:
    """-2 to 2 from a mean on the same scale."""
    c = r["sentiment"]["band_cutoffs"]
    return (
        F.when(mean.isNull(), F.lit(None).cast("int"))
        .when(mean >= c["plus2_at"], 2)
        .when(mean >= c["plus1_at"], 1)
        .when(mean <= c["minus2_at"], -2)
        .when(mean <= c["minus1_at"], -1)
        .otherwise(0)
    )


def to_integer(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.round(x).cast("int")


def to_points(x: Column, r: Rubric = DEFAULT) -> Column:
    return F.bround(x * r["sentiment"]["points_scale"]).cast("int")


def band_of_points(x: Column, r: Rubric = DEFAULT) -> Column:
    b, p = r["sentiment"]["bands"], to_points(x, r)
    return F.signum(p).cast("int") * F.when(F.abs(p) >= b["plus2"], 2).when(F.abs(p) >= b["plus1"], 1).otherwise(0)


def weighted_mean(evidence: DataFrame, as_of: Column, by: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """(by, n_events, n_signal, weighted_mean, weighted_band).

    Zeros are left out if at least ``min_signal_events`` rows aren't zero. Both sums are made in one aggregate, with
    and without zeros (a zero adds to the weights only), so no row is read twice.
    """
    c = r["sentiment"]
    w = event_weight(F.col("published"), F.col("confidence"), as_of, r)
    s = F.col("sentiment").cast("double")
    rows = evidence.where(feeds_sentiment(r)).select(*by, s.alias("s"), w.alias("w"), is_results(r).alias("res"))
    signal = F.col("s") != 0
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(signal).alias("n_signal"),
        F.sum(F.col("w") * F.col("s")).alias("ws"),
        F.sum("w").alias("w_all"),
        F.sum(F.when(signal, F.col("w"))).alias("w_signal"),
        F.max(signal & F.col("res") & (F.col("s") <= -1)).alias("offset"),
        F.sum(F.when(signal & F.col("res"), F.col("w") * F.col("s"))).alias("res_ws"),
        F.sum(F.when(signal & F.col("res"), F.col("w"))).alias("res_w"),
    )
    return mean_of_sums(sums, by, r)


def mean_of_sums(sums: DataFrame, keep: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """(keep, n_events, n_signal, weighted_mean, weighted_band) from the sums of ``weighted_mean``, however they were made."""
    c = r["sentiment"]
    use = (F.col("n_signal") >= c["min_signal_events"]) if c["aggregation"] == "signal_events" else F.lit(False)
    mean = F.col("ws") / F.when(use, F.col("w_signal")).otherwise(F.col("w_all"))
    if c["plus_two_requires_no_results_offset"]:
        top = (c["bands"]["plus2"] - 1) / c["points_scale"]
        mean = F.when(use & (mean > top) & F.col("offset"), F.lit(top)).otherwise(mean)
    if c["minus_one_when_results_negative"]:
        low = float(c["results_dominance_threshold"])
        mean = F.when((F.col("res_ws") / F.col("res_w") <= low) & (mean > low), F.lit(low)).otherwise(mean)
    return sums.select(*keep, "n_events", "n_signal", mean.alias("weighted_mean")).withColumn("weighted_band", band(F.col("weighted_mean"), r))


def raw_mean(evidence: DataFrame, by: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """(by, raw_mean, raw_band): the plain mean of labels, zeros left out if any isn't zero."""
    s = F.col("sentiment").cast("double")
    out = evidence.where(feeds_sentiment(r)).groupBy(*by).agg(F.coalesce(F.avg(F.nullif(s, F.lit(0.0))), F.avg(s)).alias("raw_mean"))
    return out.withColumn("raw_band", band(F.col("raw_mean"), r))


def pooled(evidence: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of a sector with each url once, the first by (holding_seq, seq). Rows without a url are all kept unless
    ``strict``. The first is found by an aggregate over urls, so no sector is sorted."""
    key = F.lower(F.trim(F.coalesce("url", F.lit(""))))
    news = evidence.where("kind = 'news'").withColumn("__u", key)
    some = news if strict else news.where("__u <> ''")
    first = some.groupBy("sector", "__u").agg(F.min(F.struct(*[c for c in ("holding_seq", "seq") if c in evidence.columns], *[c for c in evidence.columns if c not in ("sector", "holding_seq", "seq")])).alias("x"))
    out = first.select("sector", "x.*").select(*evidence.columns)
    return out if strict else out.unionByName(news.where("__u = ''").select(*evidence.columns))


def evidence_standard(evidence: DataFrame, by: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """Counts, span and the first reason why evidence is insufficient (empty if it is enough)."""
    c = r["sentiment"]
    out = (
        evidence.where(is_evidence())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_results(r)).alias("n_results"),
            F.count_if(F.col("event_type").isin(*c["results_event_types"])).alias("n_prints"),
            F.array_sort(F.collect_set("win")).alias("windows"),
            F.min("published").alias("first"),
            F.max("published").alias("last"),
            F.max(F.col("confidence").isNotNull()).alias("event_mode"),
        )
    )
    n, nw = F.col("n").cast("string"), F.size("windows")
    events = (
        F.when(F.col("n") < c["min_events"], F.concat(F.lit("only "), n, F.lit(" event(s)")))
        .when(nw < c["min_windows"], F.concat(F.lit("only "), nw.cast("string"), F.lit(" window(s)")))
        .when(F.col("n_results") < c["min_results_events"], "no results event")
        .otherwise("")
    )
    legacy = (
        F.when(F.col("n") < c["min_relevant_articles"], F.concat(F.lit("only "), n, F.lit(" article(s)")))
        .when(F.lit(c["require_results_print"]) & (F.col("n_prints") == 0), "no results item")
        .otherwise("")
    )
    out = out.withColumn("span_days", F.datediff("last", "first")).withColumn("insufficient", F.when(F.col("event_mode"), events).otherwise(legacy))
    return out.withColumn("collapsed", F.coalesce(F.col("span_days") < c["min_span_days"], F.lit(False))).drop("n_prints")


def coverage(evidence: DataFrame, as_of: Column, by: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """Rows by window, shares of the weight by window, share of well-sourced news, dominance of one window."""
    c = r["sentiment"]
    feeds, w = feeds_sentiment(r), event_weight(F.col("published"), F.col("confidence"), as_of, r)
    rows = evidence.where("kind = 'news'").select(*by, "win", "max_tier", "confidence", feeds.alias("on"), w.alias("w"))
    out = rows.groupBy(*by).agg(
        *[F.count_if(F.col("on") & (F.col("win") == k)).alias(f"w{k}") for k in range(1, 5)],
        F.count_if("on").alias("n_events"),
        F.avg(F.coalesce(F.col("max_tier").isin("T1", "T2"), F.lit(False)).cast("double")).alias("tier12_share"),
        F.sum(F.when(F.col("on"), F.coalesce("confidence", F.lit(1.0)))).alias("confidence_n"),
        F.sum(F.when(F.col("on"), F.col("w"))).alias("weight"),
        *[F.coalesce(F.sum(F.when(F.col("on") & (F.col("win") == k), F.col("w"))), F.lit(0.0)).alias(f"weight{k}") for k in range(1, 5)],
    )
    most = F.greatest("w1", "w2", "w3", "w4")
    return out.select(
        *by,
        "w1", "w2", "w3", "w4", "n_events", "tier12_share", "confidence_n",
        *[(F.col(f"weight{k}") / F.col("weight")).alias(f"share{k}") for k in range(1, 5)],
        ((F.col("n_events") >= 6) & (most / F.col("n_events") > c["window_dominance"])).alias("dominated"),
    )


def terms(evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """Each row that feeds sentiment with its weight, whether it counts, its share of the symbol's weight and its push
    on the mean."""
    c = r["sentiment"]
    sym = Window.partitionBy("symbol")
    rows = evidence.where(feeds_sentiment(r)).withColumn("w", event_weight(F.col("published"), F.col("confidence"), as_of, r))
    use = (F.count_if(F.col("sentiment") != 0).over(sym) >= c["min_signal_events"]) if c["aggregation"] == "signal_events" else F.lit(False)
    rows = rows.withColumn("counted", ~use | (F.col("sentiment") != 0))
    total = F.sum(F.when(F.col("counted"), F.col("w"))).over(sym)
    return rows.withColumn("share", F.when(F.col("counted"), F.col("w") / total)).withColumn("push", F.col("share") * F.col("sentiment"))


def drivers(evidence: DataFrame, as_of: Column, top: int = 3, r: Rubric = DEFAULT) -> DataFrame:
    """The ``top`` pushes up and down of each symbol."""
    rows = terms(evidence, as_of, r).where("counted and push <> 0").withColumn("side", F.when(F.col("push") > 0, "up").otherwise("down"))
    w = Window.partitionBy("symbol", "side").orderBy(F.abs("push").desc(), "seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("symbol", "side", "rank", "seq", "event_type", "sentiment", "share", "push")


def driver_facts(evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    t = terms(evidence, as_of, r)
    recent = (F.datediff(as_of, "published") <= 90) & F.col("counted")
    return t.groupBy("symbol").agg(
        F.count_if(F.col("counted") & (F.col("sentiment") > 0)).alias("n_up"),
        F.count_if(F.col("counted") & (F.col("sentiment") < 0)).alias("n_down"),
        F.count_if(~F.col("counted")).alias("n_not_counted"),
        F.coalesce(F.sum(F.when(recent, F.col("share"))), F.lit(0.0)).alias("recent_share"),
    )


def window_summary(evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """Labels by symbol and window; windows without rows have zeros."""
    grid = symbols.select("symbol").distinct().join(symbols.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("win")))
    names = {-2: "m2", -1: "m1", 0: "zero", 1: "p1", 2: "p2"}
    counts = evidence.where("kind = 'news'").groupBy("symbol", "win").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("sentiment") == k).alias(v) for k, v in names.items()])
    out = grid.join(counts, ["symbol", "win"], "left").na.fill(0, ["n", *names.values()])
    total = F.sum("n").over(Window.partitionBy("symbol"))
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def relative(scores: DataFrame, columns: list[str], r: Rubric = DEFAULT) -> DataFrame:
    """Adds z-scores over all rows, winsorised; null with fewer than two values, 0 without any spread. The moments are
    one row, joined by broadcast."""
    k = r["winsor_sigma"]
    moments = scores.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"), F.count(c).alias(f"{c}__n"))])
    out = scores.join(F.broadcast(moments))
    for c in columns:
        m, s, n, x = F.col(f"{c}__m"), F.col(f"{c}__s"), F.col(f"{c}__n"), F.col(c).cast("double")
        cut = F.least(F.greatest(x, m - k * s), m + k * s)
        out = out.withColumn(f"{c}_z", F.when(x.isNull() | (n < 2), F.lit(None)).when(s == 0, 0.0).otherwise((cut - m) / s))
    return out.drop(*[f"{c}__{p}" for c in columns for p in "msn"])
