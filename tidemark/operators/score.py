"""The score roll-up: one row for each holding, and the tables behind a run's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rubric import DEFAULT, Rubric
from . import actions, governance, sentiment
from .governance import lookup


def score_portfolio(holdings: DataFrame, evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT, dedupe: bool = True) -> DataFrame:
    """Holdings (symbol, sector) with their sentiment, governance and action scores. Holdings without evidence stay,
    with no sentiment and a clean governance score. All parts group by symbol, so one exchange serves most of them."""
    s = sentiment
    weighted = s.weighted_mean(evidence, as_of, ["symbol"], r)
    raw = s.raw_mean(evidence, ["symbol"], r)
    standard = s.evidence_standard(evidence, ["symbol"], r).select("symbol", "n", "insufficient", "collapsed", "span_days")
    sector = s.weighted_mean(s.pooled(evidence), as_of, ["sector"], r).select("sector", F.col("weighted_band").alias("sector_sentiment"))
    gov = governance.governance(evidence, holdings, as_of, r, dedupe)
    act = actions.risk_opportunity(actions.event_scores(actions.unique_actions(evidence, r), as_of, r), r)
    out = holdings.join(weighted, "symbol", "left").join(raw, "symbol", "left").join(standard, "symbol", "left")
    out = out.join(sector, "sector", "left").join(gov, "symbol", "left").join(act, "symbol", "left")
    lacking = F.coalesce(F.nullif("insufficient", F.lit("")), F.when(F.col("n").isNull(), "no evidence"))
    low = (F.coalesce("n_events", F.lit(0)) < r["low_below_items"]) | lacking.isNotNull() | F.coalesce("collapsed", F.lit(False))
    return out.select(
        "symbol",
        "sector",
        F.when(lacking.isNull(), F.col("weighted_mean")).alias("sentiment_mean"),
        F.when(lacking.isNull(), F.col("weighted_band")).alias("sentiment_band"),
        "raw_mean",
        "raw_band",
        "sector_sentiment",
        "governance_score",
        "governance_label",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("opportunity_score", F.lit(0.0)).alias("opportunity_score"),
        F.coalesce("risk_band", actions.action_band(F.lit(0.0), r)).alias("risk_band"),
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
        low.alias("low_confidence"),
        lacking.alias("note"),
    )


def ordered(scores: DataFrame) -> DataFrame:
    """The report's order: sentiment, then governance, both falling, unscored last."""
    return scores.orderBy(F.coalesce("sentiment_band", F.lit(-9)).desc(), F.col("governance_score").desc(), "symbol")


def workings(evidence: DataFrame, holdings: DataFrame, as_of: Column, r: Rubric = DEFAULT, dedupe: bool = True) -> DataFrame:
    """The arithmetic of each score in long form: (symbol, part, seq, label, value, running)."""
    none = F.lit(None).cast("double")
    t = sentiment.terms(evidence, as_of, r)
    terms = t.select("symbol", F.when(F.col("counted"), "sentiment term").otherwise("not counted").alias("part"), "seq", F.col("event_type").alias("label"), F.col("push").alias("value"), none.alias("running"))
    means = sentiment.weighted_mean(evidence, as_of, ["symbol"], r).select("symbol", F.lit("sentiment mean").alias("part"), F.lit(None).cast("long").alias("seq"), F.lit("").alias("label"), F.col("weighted_mean").alias("value"), none.alias("running"))
    applied = governance.penalties(evidence, as_of, r, dedupe)
    pens = governance.running_scores(applied, r).select("symbol", F.lit("penalty").alias("part"), "seq", F.col("event_type").alias("label"), F.col("eff").alias("value"), "running")
    left = governance.gate(evidence.where("governance_flag"), r).where("penalty is null").select("symbol", F.lit("not penalised").alias("part"), "seq", F.col("bucket").alias("label"), none.alias("value"), none.alias("running"))
    acts = actions.event_scores(actions.unique_actions(evidence, r), as_of, r).select("symbol", F.lit("action").alias("part"), "seq", F.col("event_type").alias("label"), F.col("score").alias("value"), none.alias("running"))
    return terms.unionByName(means).unionByName(pens).unionByName(left).unionByName(acts)


def drop_totals(dropped: DataFrame) -> DataFrame:
    """Dropped rows by symbol and reason, with totals by symbol and over all (null keys)."""
    return dropped.rollup("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


def label_failures(labelled: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Share of rows without a usable label, and whether it is over the limit."""
    share = F.avg((~F.col("labelled")).cast("double"))
    return labelled.agg(F.count(F.lit(1)).alias("n"), share.alias("failure_share"), (F.coalesce(share, F.lit(0.0)) > r["label_failure_limit"]).alias("over_limit"))


def label_split(now: DataFrame, before: DataFrame) -> DataFrame:
    """Labels of governance now and in the run before, with each one's share and whether the share needs a note."""
    a = now.groupBy(F.col("governance_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    b = before.groupBy(F.col("governance_label").alias("label")).agg(F.count(F.lit(1)).alias("n_before"))
    out = a.join(b, "label", "full_outer").na.fill(0, ["n", "n_before"])
    total = a.agg(F.sum("n").alias("total"))
    out = out.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))
    note = ((F.col("label") == "Clean") & (F.col("share") >= 0.6)) | ((F.col("label") == "Flag") & (F.col("share") >= 0.3))
    return out.select("label", "n", "n_before", "share", note.alias("noted"))


def portfolio_facts(scores: DataFrame) -> DataFrame:
    """Counts over a whole portfolio in one row."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("sentiment_band") == k).alias(name) for k, name in ((-2, "m2"), (-1, "m1"), (0, "zero"), (1, "p1"), (2, "p2"))],
        F.count_if(F.col("sentiment_band").isNull()).alias("unscored"),
        *[F.count_if(F.col("governance_label") == x).alias(x.lower()) for x in ("Clean", "Watch", "Flag")],
        *[F.count_if(F.col("risk_band") == x).alias(f"risk_{x.lower()}") for x in ("Review", "Act", "Exit")],
        F.count_if("low_confidence").alias("low_confidence"),
    )


#: Types that tell of one kind of governance event (fixed values of the rubric's lessons).
KINDS_OF_EVENT = {"regulatory_action": "reg", "investigation": "reg", "exchange_fine": "reg", "management_exit": "people", "board_independence": "people", "rpt_concern": "rpt"}


def missed(verified: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified rows for which a run found no governance event of their symbol and kind; types without a kind are never found."""
    kind = lookup(F.col("event_type"), KINDS_OF_EVENT)
    found = evidence.where("governance_flag").select("symbol", kind.alias("kind")).where("kind is not null").distinct()
    return verified.withColumn("kind", kind).join(found, ["symbol", "kind"], "left_anti")


def anomalies(
    scores: DataFrame, applied: DataFrame, evidence: DataFrame, labelled: DataFrame, standard: DataFrame, r: Rubric = DEFAULT,
    drops: DataFrame | None = None, linted: DataFrame | None = None, verified: DataFrame | None = None, against: DataFrame | None = None,
) -> DataFrame:
    """Proposals (kind, key, lesson_id) of what a person should look at in a run, one small query each.

    Where they are given: ``drops`` (symbol, reason) tell of loose queries, ``linted`` rows of price language, ``verified``
    rows of events that the run's ``evidence``, found without them, lacks, and ``against`` (symbol, governance_score) of another run
    that disagrees."""
    parts = []

    def add(rows: DataFrame, kind: str, key: Column | str) -> None:
        parts.append(rows.select(F.lit(kind).alias("kind"), (F.lit(key) if isinstance(key, str) else key).alias("key")))

    tier = F.coalesce("role_tier", F.lit(""))
    add(applied.where((F.col("event_type") == "management_exit") & (tier != r["governance"]["exit_requires_role_tier"])), "benign_people_penalised", F.concat_ws("|", "symbol", F.col("seq").cast("string")))
    add(applied.where((F.coalesce("materiality", F.lit("")) == "low") & (F.col("eff") <= -15)), "immaterial_heavy_penalty", F.concat_ws("|", "symbol", F.col("seq").cast("string")))
    add(standard.where("collapsed and insufficient = ''"), "collapsed_window", F.col("symbol"))
    add(standard.where("insufficient <> ''"), "insufficient_data", F.col("symbol"))
    share = lambda x: F.avg((F.col("governance_label") == x).cast("double"))
    split = scores.agg(share("Flag").alias("flag"), share("Clean").alias("clean"), F.stddev_pop("sentiment_mean").alias("spread"))
    add(split.where("flag >= 0.3"), "many_flags", "portfolio")
    add(split.where("clean >= 0.6"), "many_clean", "portfolio")
    add(split.where("spread < 0.25"), "compressed_sentiment", "portfolio")
    if drops is not None:
        other = F.count_if(F.substring_index("reason", ":", 1) == "not_about_company")
        add(drops.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), other.alias("other")).where("other >= 5 and other / n >= 0.4"), "loose_query", F.col("symbol"))
    add(labelled.where(~F.col("labelled")), "label_failures", F.col("symbol"))
    if linted is not None:
        add(linted.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "price_language", F.col("n").cast("string"))
    if verified is not None:
        add(missed(verified, evidence), "verified_event_missed", F.concat("symbol", F.lit("|"), F.coalesce("event_key", F.lit(""))))
    if against is not None:
        both = scores.join(against.select("symbol", F.col("governance_score").alias("other")), "symbol").where("governance_score <> other")
        add(both, "runs_disagree", F.concat_ws("|", "symbol", F.col("governance_score").cast("string"), F.col("other").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.distinct()
    return out.withColumn("lesson_id", F.concat(F.lit("L-"), F.substring(F.sha1(F.concat_ws("|", "kind", "key")), 1, 8)))


def narration(scores: DataFrame, drivers: DataFrame) -> DataFrame:
    """A plain sentence for each holding from its scores and its strongest pushes."""
    line = F.concat(F.col("event_type"), F.lit(" "), F.format_number("push", 2))
    top = drivers.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("push")).alias("k"), line.alias("line")))), lambda x: x["line"]), "; ").alias("pushes"))
    lead = F.when(F.col("sentiment_band").isNull(), F.concat(F.lit("Sentiment not scored: "), F.coalesce("note", F.lit("")))).otherwise(F.concat(F.lit("Sentiment "), F.col("sentiment_band").cast("string")))
    text = F.concat(F.col("symbol"), F.lit(": "), lead, F.lit(". Governance "), F.col("governance_label"), F.lit(". Action risk "), F.col("risk_band"), F.lit("."), F.coalesce(F.concat(F.lit(" Pushes: "), "pushes", F.lit(".")), F.lit("")))
    return scores.join(top, "symbol", "left").select("symbol", text.alias("commentary"))


def golden(cases: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Cases (id, expected: penalise or reject, expected_weight and the gate's columns) with what the gate says and ok."""
    out = governance.gate(cases, r)
    right = F.when(F.col("expected") == "penalise", F.col("penalty").isNotNull() & (F.col("expected_weight").isNull() | (F.col("penalty") == F.col("expected_weight")))).otherwise(F.col("penalty").isNull())
    return out.select("id", "expected", "bucket", "penalty", F.coalesce(right, F.lit(False)).alias("ok"))
