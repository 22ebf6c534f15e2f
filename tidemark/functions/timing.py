"""Column functions over dates: age, sampling window, recency weight, age taper, quarter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rubric import DEFAULT, Rubric


def as_date(text: Column) -> Column:
    """The date in the first ten characters, null if there is none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def compact_date(text: Column) -> Column:
    """The date of a compact stamp such as 20260703T101500Z."""
    return F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")


def age_days(published: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, published), F.lit(0))


def window_of(published: Column, as_of: Column, r: Rubric = DEFAULT) -> Column:
    """1 to 4 by age, null outside (the future included)."""
    age = F.datediff(as_of, published)
    out = F.lit(None).cast("int")
    for k, (lo, hi, _) in reversed(list(enumerate(r["sampling"]["windows"], 1))):
        out = F.when(age.between(lo, hi), F.lit(k)).otherwise(out)
    return out


def recency_weight(published: Column, as_of: Column, r: Rubric = DEFAULT) -> Column:
    """A flat weight by age, or, without such weights, a half-life in trading days with a floor."""
    s = r["sentiment"]
    age = age_days(published, as_of)
    flat = s["window_weights"]
    if flat:
        out = F.lit(float(flat[-1][1]))
        for days, w in reversed(flat):
            out = F.when(age <= days, F.lit(float(w))).otherwise(out)
        return out
    trading = age * F.lit(float(s["trading_days_per_year"])) / F.lit(365.0)
    return F.greatest(F.lit(float(s["recency_floor"])), F.pow(F.lit(0.5), trading / F.lit(float(s["half_life_trading_days"]))))


def event_weight(published: Column, confidence: Column, as_of: Column, r: Rubric = DEFAULT) -> Column:
    w = recency_weight(published, as_of, r)
    return w * F.coalesce(confidence, F.lit(1.0)) if r["sentiment"]["use_source_confidence"] else w


def age_factor(published: Column, as_of: Column, r: Rubric = DEFAULT) -> Column:
    """1 while young, then falling in a straight line to the end factor; 1 without a date."""
    t = r["governance"]["age_taper"]
    age = F.datediff(as_of, published)
    part = F.least(F.lit(1.0), (age - t["full_days"]) / F.lit(float(max(1, t["end_days"] - t["full_days"]))))
    return F.when(age > t["full_days"], 1.0 - part * F.lit(1.0 - t["end_factor"])).otherwise(F.lit(1.0))


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
