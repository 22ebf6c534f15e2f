"""Corporate actions: repeats dropped, event scores, risk and opportunity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import half_even
from ..functions.text import numbers
from ..plans.rubric import DEFAULT, Rubric
from .governance import lookup

ACTION_COLUMNS = {"severity": "string", "materiality": "string", "substance": "string", "ca_stage": "string", "ca_size_pct": "double", "ca_days_to_effective": "double"}


def unique_actions(rows: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Rows of an action type without repeats: the same type and figures within its days of any earlier row, repeats
    included, which makes it a gap between neighbours in time."""
    a = r["actions"]
    known = [*a["severity"], "capacity_expansion", *a["tracked_types"]]
    rows = rows.where(F.col("event_type").isin(*known)).withColumn("__sig", numbers(F.col("title")))
    w = Window.partitionBy("symbol", "event_type", "__sig").orderBy(F.col("published").asc_nulls_first(), "seq")
    before, oldest = F.lag("published").over(w), F.first("published").over(w)
    days = F.when(F.col("event_type") == "dividend", a["dividend_days"]).otherwise(a["other_days"])
    first = F.row_number().over(w) == 1
    # rows without a date come first; such a row and any other of its kind are one action
    keep = first | (oldest.isNotNull() & F.coalesce(F.datediff("published", before) > days, F.lit(False)))
    return rows.withColumn("__keep", keep).where("__keep").drop("__keep", "__sig")


def event_scores(rows: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """Adds severity_points, stage, stage_mult, timing_mult, size_mult, score (10 at most, to two places), direction,
    gate_a, gate_b and tracked_only. Types outside the severity table have no score; tracked types stay, as tracked only."""
    a, t = r["actions"], r["actions"]["timing"]
    for name, kind in ACTION_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    et = F.col("event_type")
    rows = rows.where(et.isin(*a["severity"], *a["tracked_types"]))
    points = lookup(et, {k: float(x) for k, x in a["severity"].items()})
    stage = F.coalesce(F.nullif(F.col("ca_stage"), F.lit("")), F.lit(a["stage_default"]))
    by_stage = F.coalesce(lookup(stage, {k: float(x) for k, x in a["stage_multiplier"].items()}), F.lit(float(a["stage_multiplier"][a["stage_default"]])))
    ahead = F.col("ca_days_to_effective")
    age = F.coalesce(F.greatest(F.datediff(as_of, "published"), F.lit(0)), F.lit(0))
    half = F.coalesce(lookup(et, {k: float(x) for k, x in a["half_life_days"].items()}), F.lit(float(a["half_life_default"])))
    past = F.greatest(F.lit(float(a["timing_floor"])), F.pow(F.lit(0.5), age / half))
    timing = F.when(ahead > 0, F.when(ahead < 15, float(t["under_15d"])).when(ahead <= 60, float(t["from_15_to_60d"])).otherwise(float(t["over_60d"]))).otherwise(past)
    size = F.lit(float(a["size_bands"][-1][1]))
    for most, m in reversed(a["size_bands"]):
        size = F.when(F.col("ca_size_pct") <= most, float(m)).otherwise(size)
    told = et.isin(*a["size_materiality_types"]) & F.col("materiality").isNotNull()
    by_size = F.when(F.col("ca_size_pct").isNotNull(), size).when(told, F.coalesce(lookup(F.col("materiality"), {k: float(x) for k, x in a["size_by_materiality"].items()}), F.lit(1.0))).otherwise(1.0)
    out = rows.select("*", points.alias("severity_points"), stage.alias("stage"), by_stage.alias("stage_mult"), timing.alias("timing_mult"), by_size.alias("size_mult"))
    gate_a = et.isin(*a["gate_a_types"]) | ((et == "auditor_resignation") & (F.coalesce("severity", F.lit("")) == a["gate_a_auditor_severity"]))
    gate_b = et.isin(*a["gate_b_types"])
    done = F.col("stage").isin(*a["stages_excluded"]) & ~gate_a & ~gate_b
    raw = F.col("severity_points") * F.col("stage_mult") * F.col("timing_mult") * F.col("size_mult")
    out = out.withColumn("__raw", F.least(F.lit(10.0), raw))
    direction = F.when(F.col("sentiment") > 0, "positive").when(F.col("sentiment") < 0, "negative").otherwise("unclear")
    return out.select("*", half_even(F.col("__raw")).alias("score"), direction.alias("direction"), gate_a.alias("gate_a"), gate_b.alias("gate_b"), (et.isin(*a["tracked_types"]) | done).alias("tracked_only")).drop("__raw")


def action_band(score: Column, r: Rubric = DEFAULT, strict: bool = False) -> Column:
    """The band of a risk score. The published ranges leave gaps (2.95 is in none and falls to the last); without
    ``strict`` the bands meet."""
    a = r["actions"]
    if strict:
        out = None
        for lo, hi, name in a["strict_bands"]:
            hit = (score >= lo) & (score <= hi + 1e-9)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(a["strict_bands"][-1][2])
    out = None
    for name, below in a["bands"]:
        out = F.when(score < below, name) if out is None else out.when(score < below, name)
    return out


def combined(on: Column) -> Column:
    """Ten times the chance that at least one of the scored events bites; 0 without any. Factors are multiplied in
    order of date and seq, so equal rows give equal doubles; a symbol's events of a lookback are a short array."""
    scores = F.array_sort(F.collect_list(F.when(on, F.struct("published", "seq", "score"))))
    return F.lit(10.0) * (1 - F.aggregate(scores, F.lit(1.0), lambda a, x: a * (1 - x["score"] / 10)))


def risk_opportunity(scored: DataFrame, r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    """(symbol, risk_score, opportunity_score, risk_band, opportunity_review and counts) from event scores."""
    live = ~F.col("tracked_only") & ~F.col("gate_b") & (F.coalesce("substance", F.lit("primary")) != "passing")
    primary = F.coalesce("substance", F.lit("primary")) != "passing"
    up = F.col("direction") == "positive"
    out = scored.groupBy("symbol").agg(
        combined(live & ~up).alias("risk"),
        combined(live & up).alias("opportunity"),
        F.coalesce(F.max(live & F.col("gate_a")), F.lit(False)).alias("exit"),
        F.count_if(live).alias("n_scored"),
        F.count_if(primary & F.col("gate_b") & ~F.col("tracked_only")).alias("n_quarantined"),
        F.count_if(primary & F.col("tracked_only")).alias("n_tracked"),
    )
    out = out.withColumn("risk_score", F.when(F.col("exit"), 10.0).otherwise(half_even(F.col("risk")))).withColumn("opportunity_score", half_even(F.col("opportunity")))
    name = F.when(F.col("exit"), "Exit").otherwise(action_band(F.col("risk_score"), r, strict))
    return out.select("symbol", "risk_score", "opportunity_score", name.alias("risk_band"), (F.col("opportunity_score") >= r["actions"]["opportunity_review_at"]).alias("opportunity_review"), "n_scored", "n_quarantined", "n_tracked")


def quarantined(scored: DataFrame) -> DataFrame:
    """Quarantined actions by type: their direction or 'mixed', how many, and the newest headline."""
    rows = scored.where("gate_b and not tracked_only")
    one = F.when(F.count_distinct("direction") == 1, F.min("direction")).otherwise("mixed")
    return rows.groupBy("symbol", "event_type").agg(one.alias("direction"), F.count(F.lit(1)).alias("n"), F.max_by("title", F.struct("published", "seq")).alias("newest"))


def review_queue(risk: DataFrame, holdings: DataFrame) -> DataFrame:
    """Risk times the position's weight over the mean weight."""
    mean = holdings.agg(F.avg("weight").alias("__m"))
    return risk.join(holdings.select("symbol", "weight"), "symbol").join(mean).select("symbol", "risk_score", (F.col("risk_score") * F.col("weight") / F.col("__m")).alias("priority"))
