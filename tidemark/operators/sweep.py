"""The sentiment of every date of a span by running sums.

A copy of an event counts from the day it can be seen until a later run's copy takes its place, and its weight changes
where it passes from one window to the next. So a copy is a few signed changes, and a date's sums are those of all
changes up to it: events x windows rows, whatever the number of dates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rubric import DEFAULT, Rubric
from . import sentiment


def lives(events: DataFrame, manifests: DataFrame, r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    """Events with (since, until): the dates at which a copy is the latest that can be seen; until is null if nothing
    takes its place. Copies that a later run's copy hides at all dates have no row."""
    known = F.greatest("as_of", "fetched") if strict else F.col("as_of")
    runs = manifests.where(F.coalesce("mode", F.lit("")) != "pit-replay").where(known.isNotNull() & (F.col("fetched").isNotNull() if strict else F.lit(True)))
    runs = runs.select("run_id", F.date_sub(known, r["pit_grace_days"]).alias("__seen"))
    rows = events.where("event_date is not null").join(F.broadcast(runs), "run_id")  # few runs hold all events
    rows = rows.withColumn("since", F.greatest("event_date", "__seen")).drop("__seen")
    later = Window.partitionBy("event_id").orderBy(F.col("run_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("until", F.min("since").over(later)).where("until is null or since < until")


def weight_steps(published: Column, since: Column, until: Column, r: Rubric = DEFAULT) -> Column:
    """The parts of a life in which the weight stays the same, as structs (lo, hi, w), hi exclusive. An undated event
    keeps the first weight."""
    flat = r["sentiment"]["window_weights"]
    steps = []
    for k, (days, w) in enumerate(flat):
        lo = since if k == 0 else F.greatest(since, F.date_add(published, flat[k - 1][0] + 1))
        hi = until if k == len(flat) - 1 else F.least(until, F.date_add(published, days + 1))  # least and greatest pass over nulls
        one = F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(float(w)).alias("w"))
        steps.append(one if k == 0 else F.when(published.isNotNull(), one))
    return F.filter(F.array(*steps), lambda x: x.isNotNull() & (x["lo"] < x["hi"]))


def mean_intervals(events: DataFrame, manifests: DataFrame, start: str, end: str, r: Rubric = DEFAULT, by: tuple[str, ...] = ("symbol",), strict: bool = False) -> DataFrame:
    """(by, since, until, n_events, n_signal, weighted_mean, weighted_band): spans of dates, until exclusive, in which
    nothing changes. Dates without an event that counts have no row.

    Sums are decimals of twelve places, so what is added and taken away again leaves nothing behind. A key has a row for
    each date of the span at most, so one key's window is bounded by the span. Weights must be flat by window: a
    half-life changes every weight every day, and ``corpus.backtest`` serves it."""
    c = r["sentiment"]
    if not c["window_weights"]:
        raise ValueError("weights by half-life change every day; use the backtest")
    first, after = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    rows = lives(events, manifests, r, strict).where(sentiment.feeds_sentiment(r))
    rows = rows.withColumn("since", F.greatest("since", first)).withColumn("until", F.least("until", after)).where("since < until")
    sure = F.coalesce("confidence", F.lit(1.0)) if c["use_source_confidence"] else F.lit(1.0)
    s = F.col("sentiment").cast("double")
    rows = rows.select(*by, s.alias("s"), sure.alias("sure"), sentiment.is_results(r).alias("res"), F.explode(weight_steps(F.col("published"), F.col("since"), F.col("until"), r)).alias("x"))
    rows = rows.select(*by, "s", "res", (F.col("x.w") * F.col("sure")).alias("w"), F.explode(F.array(F.struct(F.col("x.lo").alias("day"), F.lit(1).alias("sign")), F.struct(F.col("x.hi").alias("day"), F.lit(-1).alias("sign")))).alias("e"))
    signal, zero = F.col("s") != 0, F.lit(0)
    exact = lambda x: F.col("e.sign") * x.cast("decimal(20,12)")
    counted = lambda cond: F.when(cond, F.col("e.sign")).otherwise(zero)
    w, ws = F.col("w"), F.col("w") * F.col("s")
    sums = {
        "n_events": F.col("e.sign"), "n_signal": counted(signal), "ws": exact(ws), "w_all": exact(w), "w_signal": F.when(signal, exact(w)),
        "n_offset": counted(signal & F.col("res") & (F.col("s") <= -1)), "n_res": counted(signal & F.col("res")), "res_ws": F.when(signal & F.col("res"), exact(ws)), "res_w": F.when(signal & F.col("res"), exact(w)),
    }
    changes = rows.groupBy(*by, F.col("e.day").alias("since")).agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    moved = reduce(lambda p, q: p | q, [F.coalesce(F.col(n), zero) != 0 for n in sums])
    changes = changes.where(moved)  # a weight that ends where the same one begins
    key = Window.partitionBy(*by).orderBy("since")
    upto = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = changes.select(*by, "since", F.coalesce(F.lead("since").over(key), after).alias("until"), *[F.sum(n).over(upto).alias(n) for n in sums]).where("n_events > 0 and since < until")
    at = at.withColumns({n: F.col(n).cast("double") for n in ("ws", "w_all", "w_signal")} | {n: F.when(F.col("n_res") > 0, F.col(n).cast("double")) for n in ("res_ws", "res_w")} | {"offset": F.col("n_offset") > 0})
    return sentiment.mean_of_sums(at, [*by, "since", "until"], r)


def at_dates(intervals: DataFrame, start: str, end: str, step_days: int = 1) -> DataFrame:
    """Intervals as rows of the dates from start on in steps, as_of in place of since and until."""
    first = F.lit(start).cast("date")
    number = lambda c: F.ceil(F.datediff(F.col(c), first) / F.lit(step_days)).cast("int")
    last = F.floor(F.datediff(F.lit(end).cast("date"), first) / F.lit(step_days)).cast("int")
    rows = intervals.withColumn("__lo", F.greatest(number("since"), F.lit(0))).withColumn("__hi", F.least(number("until") - 1, last)).where("__lo <= __hi")
    rows = rows.withColumn("__k", F.explode(F.sequence("__lo", "__hi"))).withColumn("as_of", F.date_add(first, F.col("__k") * step_days))
    return rows.select("as_of", *[c for c in intervals.columns if c not in ("since", "until")])
