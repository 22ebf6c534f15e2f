"""The tables behind a run's report, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rubric import DEFAULT, Rubric
from ..plans.vocabulary import GENERIC_NAME_WORDS
from . import actions, governance, score, sentiment


def articles_by_window(evidence: DataFrame, dropped: DataFrame, members: DataFrame) -> DataFrame:
    """Kept rows, dropped rows with their reason, and rows merged into an event, in one table."""
    cols = ("symbol", "seq", "title", "url", "published", "win")
    kept = evidence.select(*cols, F.lit("kept").alias("state"), F.lit(None).cast("string").alias("why"))
    out = dropped.select(*cols, F.lit("dropped").alias("state"), F.col("reason").alias("why"))
    merged = members.select(*cols, F.lit("merged").alias("state"), F.concat(F.lit("into "), F.col("survivor").cast("string")).alias("why"))
    return kept.unionByName(out).unionByName(merged)


def governance_evidence(evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT, dedupe: bool = True) -> DataFrame:
    """Penalised rows with their weight, and flagged rows that weren't penalised with the bucket that kept them out."""
    gated = governance.gate(evidence.where("governance_flag"), r)
    applied = governance.penalties(evidence, as_of, r, dedupe).select("symbol", "seq", F.col("eff"))
    out = gated.join(applied, ["symbol", "seq"], "left")
    state = F.when(F.col("eff").isNotNull(), "penalised").when(F.col("penalty").isNull(), F.col("bucket")).when(F.coalesce("historical", F.lit(False)), "out of window").otherwise("counted once")
    return out.select("symbol", "seq", "event_type", "title", state.alias("state"), "penalty", "eff")


def action_events(evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """Scored, tracked and quarantined actions with what each factor was."""
    rows = actions.event_scores(actions.unique_actions(evidence, r), as_of, r)
    state = F.when(F.coalesce("substance", F.lit("primary")) == "passing", "passing").when(F.col("tracked_only"), "tracked").when(F.col("gate_b"), "quarantined").otherwise("scored")
    return rows.select("symbol", "seq", "event_type", state.alias("state"), "severity_points", "stage", "stage_mult", "timing_mult", "size_mult", "score", "direction", "gate_a")


def coverage_rows(evidence: DataFrame, dropped: DataFrame, holdings: DataFrame) -> DataFrame:
    """Rows kept and dropped for each holding, and a PORTFOLIO row over all."""
    kept = evidence.groupBy("symbol").agg(F.count(F.lit(1)).alias("kept"))
    gone = dropped.groupBy("symbol").agg(F.count(F.lit(1)).alias("dropped"))
    rows = holdings.select("symbol").distinct().join(kept, "symbol", "left").join(gone, "symbol", "left").na.fill(0, ["kept", "dropped"])
    return rows.unionByName(rows.agg(F.lit("PORTFOLIO").alias("symbol"), F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped")))


def balance(evidence: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """How one-sided each symbol's counted rows are, by the share of positive ones."""
    t = sentiment.terms(evidence, as_of, r).where("counted and sentiment <> 0")
    out = t.groupBy("symbol").agg(F.avg((F.col("sentiment") > 0).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n"))
    s = F.col("positive_share")
    name = F.when(s >= 0.75, "clearly positive").when(s >= 0.58, "mostly positive").when(s >= 0.42, "balanced").when(s >= 0.25, "mostly negative").otherwise("clearly negative")
    return out.withColumn("balance", name)


def payload(evidence: DataFrame, scores: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """What a narrator is given for each holding, as JSON, and its hash, by which commentary can be kept."""
    d = sentiment.drivers(evidence, as_of, 3, r).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("side", "rank", "event_type", "sentiment", F.format_string("%.4f", "push").alias("push")))).alias("drivers"))
    b = balance(evidence, as_of, r).select("symbol", "balance")
    rows = scores.join(d, "symbol", "left").join(b, "symbol", "left")
    text = F.to_json(F.struct("symbol", "sentiment_band", "governance_label", "risk_band", "balance", "drivers"))
    return rows.select("symbol", text.alias("payload"), F.sha2(text, 256).alias("payload_hash"))


def scorecard(scores: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """The score table in the report's order with z-scores over the portfolio."""
    rel = sentiment.relative(scores, ["sentiment_mean", "governance_score", "risk_score"], r)
    return score.ordered(rel.withColumn("as_of", as_of))


def name_tokens(holdings: DataFrame) -> DataFrame:
    """(symbol, name_tokens): lower-case strings that tie a headline to a company: its symbol, aliases (or its name
    with and without its legal form) and the words of its name that aren't generic."""
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9&']+"), F.lit(0)), lambda w: F.length(w) >= 2)
    own = F.filter(words, lambda w: ~w.isin(*GENERIC_NAME_WORDS))
    given = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    names = F.when(F.size(given) > 0, given).otherwise(F.array("name", F.concat("name", F.lit(" Ltd")), F.concat("name", F.lit(" Limited"))))
    every = F.concat(F.array(F.regexp_replace(F.lower("symbol"), "[^a-z0-9]", "")), F.transform(names, lambda a: F.lower(a)), F.when(F.size(own) > 0, own).otherwise(words))
    return holdings.select("symbol", F.array_sort(F.array_distinct(F.filter(every, lambda x: x != ""))).alias("name_tokens"))
