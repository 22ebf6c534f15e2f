"""Queries over the test tables, one for each operator or group of operators; (spark, sf_dir) to a DataFrame.

Fractions are rounded to six places here, for comparison with another engine; operators don't round.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import timing as tm
from ..operators import actions, asking, cluster, corpus, governance, label, market, sample, score, sentiment, sweep, views
from ..sources.fulltext import extract
from . import adapters as ad
from .rubric import load_rubric

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return ad.view(spark, d, ad.ORD).withColumn("win", tm.window_of(F.col("published"), day(ad.ORD_AS_OF)))


def acts(spark: SparkSession, d: str) -> DataFrame:
    return ad.view(spark, d, ad.ACT)


def events(spark: SparkSession, d: str) -> DataFrame:
    return ad.view(spark, d, ad.EV)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return ad.view(spark, d, ad.DOC_SPARK)




@query
def recency_weighted_mean(spark, d):
    return sentiment.weighted_mean(orders(spark, d), day(ad.ORD_AS_OF), ["symbol"])


@query
def recency_weighted_mean_by_customer(spark, d):
    rows = orders(spark, d).withColumn("symbol", F.concat_ws("/", "symbol", "sector", F.year("published").cast("string")))
    return sentiment.weighted_mean(rows, day(ad.ORD_AS_OF), ["symbol"])


@query
def raw_mean_banded(spark, d):
    return sentiment.raw_mean(orders(spark, d), ["symbol", "sector"])


@query
def half_life_mean(spark, d):
    r = load_rubric({"sentiment": {"window_weights": None, "use_source_confidence": True}})
    return sentiment.weighted_mean(orders(spark, d), day(ad.ORD_AS_OF), ["symbol"], r)


@query
def vetoed_mean(spark, d):
    r = load_rubric({"sentiment": {"plus_two_requires_no_results_offset": True, "minus_one_when_results_negative": True, "results_dominance_threshold": 0.01}})
    return sentiment.weighted_mean(orders(spark, d), day(ad.ORD_AS_OF), ["symbol", "sector"], r)


@query
def score_bands(spark, d):
    x = F.col("c_acctbal") / 4000.0 - 0.7
    rows = ad.view(spark, d, "SELECT c_custkey, c_acctbal FROM {customer}").select("c_custkey", x.alias("x"))
    return rows.select("c_custkey", sentiment.band(F.col("x")).alias("band"), sentiment.to_integer(F.col("x")).alias("whole"), sentiment.to_points(F.col("x")).alias("points"), sentiment.band_of_points(F.col("x")).alias("points_band"))


@query
def sector_pooled_mean(spark, d):
    rows = orders(spark, d)
    return sentiment.weighted_mean(sentiment.pooled(rows), day(ad.ORD_AS_OF), ["sector"])


@query
def evidence_standard(spark, d):
    rows = orders(spark, d).where("win is not null").withColumn("symbol", F.concat_ws("/", "symbol", "sector"))
    return sentiment.evidence_standard(rows, ["symbol"]).select("symbol", "n", "n_results", F.size("windows").alias("n_windows"), "first", "last", "span_days", "event_mode", "insufficient", "collapsed")


@query
def coverage_map(spark, d):
    return sentiment.coverage(orders(spark, d).where("win is not null"), day(ad.ORD_AS_OF), ["symbol"])


@query
def drivers_topk(spark, d):
    return sentiment.drivers(orders(spark, d), day(ad.ORD_AS_OF))


@query
def driver_facts(spark, d):
    return sentiment.driver_facts(orders(spark, d), day(ad.ORD_AS_OF))


@query
def window_summary(spark, d):
    rows = orders(spark, d)
    return sentiment.window_summary(rows.where("win is not null"), rows)


@query
def url_dedupe(spark, d):
    return sample.dedupe_by_url(docs(spark, d), ["symbol"]).select("symbol", "seq", "url")


@query
def url_keys(spark, d):
    rows = docs(spark, d)
    key = tx.item_key(F.col("url"), F.col("title"), F.col("snippet"), F.lit("keyword"), F.lit("v1"))
    return rows.select("seq", tx.url_hash(F.col("url")).alias("url_hash"), tx.title_key(F.col("title")).alias("title_key"), key.alias("item_key"), tx.event_id(F.col("symbol"), F.col("published"), F.array(tx.url_hash(F.col("url")))).alias("event_id"))


@query
def syndicated_collapse(spark, d):
    return sample.collapse_titles(docs(spark, d)).select("symbol", "seq", "n_copies")


@query
def window_of_article(spark, d):
    rows = docs(spark, d)
    return rows.select("seq", tm.window_of(F.col("published"), day(ad.DOC_AS_OF)).alias("win"), tm.recency_weight(F.col("published"), day(ad.DOC_AS_OF)).alias("weight"), tm.age_factor(F.col("published"), day(ad.DOC_AS_OF)).alias("taper"), tm.quarter_key(F.col("published")).alias("quarter"))


@query
def drop_reasons(spark, d):
    return sample.drop_reasons(sample.stratified(docs(spark, d), day(ad.DOC_AS_OF))).select("symbol", "seq", "status", "reason")


@query
def stratified_sample_capped(spark, d):
    return sample.stratified(docs(spark, d), day(ad.DOC_AS_OF)).select("symbol", "seq", "win", "status")


@query
def stratified_sample_uncapped(spark, d):
    return sample.stratified(docs(spark, d), day(ad.DOC_AS_OF), capped=False).where("status in ('selected', 'extra')").select("symbol", "seq", "win", "status")


@query
def sample_report(spark, d):
    return sample.stratified(docs(spark, d), day(ad.DOC_AS_OF)).groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_copies").alias("copies"))


@query
def sample_carries(spark, d):
    return sample.carry_log(docs(spark, d), day(ad.DOC_AS_OF))


@query
def latest_n(spark, d):
    return sample.latest(docs(spark, d), 50).select("symbol", "seq", "rank")


@query
def gov_candidates(spark, d):
    rows = docs(spark, d)
    return sample.governance_candidates(sample.unseen(rows, rows.where("seq % 7 = 0")), day(ad.DOC_AS_OF)).select("symbol", "seq", "win")


@query
def governance_pass(spark, d):
    """Titles with a governance word: orders, whose titles have some, with those of every seventh already taken."""
    rows = orders(spark, d).withColumns({"relevance": F.col("sentiment"), "title": F.concat_ws(" ", "title", F.col("seq").cast("string"))})
    return sample.governance_pass(rows, rows.where("seq % 7 = 0"), day(ad.ORD_AS_OF)).select("symbol", "seq", "win")


@query
def unique_filings(spark, d):
    return sample.unique_filings(orders(spark, d)).select("symbol", "seq", "published")


@query
def articles_seen(spark, d):
    rows = docs(spark, d)
    return sample.articles_seen(rows, sample.stratified(rows, day(ad.DOC_AS_OF)))


@query
def fundamental_buckets(spark, d):
    return sample.results_buckets(docs(spark, d), day(ad.DOC_AS_OF)).select("symbol", "seq", "bucket", "rank")


@query
def results_anchors(spark, d):
    rows = docs(spark, d).withColumn("n_sources", (F.col("seq") % 7).cast("int"))
    return sample.results_anchors(rows).select("symbol", "seq", "quarter", "rank")


@query
def month_histogram(spark, d):
    return sample.month_histogram(docs(spark, d), "2023-11-01", "2024-12-31")


@query
def title_filters(spark, d):
    t = F.col("title")
    names = F.array(F.lit("company"), F.lit("cfo"))
    rows = orders(spark, d)
    return rows.select("seq", tx.is_boilerplate(t).alias("boilerplate"), tx.governance_title(t).alias("governance"), tx.results_title(t).alias("results"), tx.price_only(t).alias("price_only"), tx.title_hit(t, names).alias("named"), tx.style(F.col("kind"), t, F.lit(""), F.lit("example.org")).alias("style"))


@query
def keyword_label(spark, d):
    x = label.keyword_label(F.col("title"), F.lit(""), F.lit(""))
    return orders(spark, d).select("seq", x.alias("x")).select("seq", "x.*")


@query
def validate_rows(spark, d):
    rows = orders(spark, d).withColumn("labelled", F.col("seq") % 23 != 0)
    out = label.validated(rows, day(ad.ORD_AS_OF), 730)
    return out.select("seq", "reason")


@query
def label_failures(spark, d):
    return score.label_failures(orders(spark, d).withColumn("labelled", F.col("seq") % 7 != 0))


@query
def price_lint(spark, d):
    return label.price_lint(orders(spark, d)).where("price_only").select("seq", "event_type", "sentiment", "governance_flag")


@query
def tier_by_domain(spark, d):
    rows = ad.view(spark, d, "SELECT page_id, url FROM {pages}").withColumn("domain", tx.domain_of(F.col("url"), F.lit("")))
    known = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("m."), F.lit("livemint.com"))).when(F.col("page_id") % 4 == 1, "reuters.com").otherwise(F.col("domain"))
    rows = rows.withColumn("domain", known).withColumn("tier", tx.tier_of(known))
    return rows.select("page_id", "domain", "tier", tx.tier_weight(F.col("tier")).alias("tier_weight"), tx.confidence((F.col("page_id") % 12).cast("int"), F.col("tier")).alias("confidence"))


@query
def fulltext_extract(spark, d):
    rows = ad.view(spark, d, "SELECT page_id, html FROM {pages}")
    return rows.select("page_id", extract(F.col("html")).alias("text"))


def title_pairs_similarity(spark, d):
    """Rounded before copies make their pairs, which are many more rows."""
    return cluster.item_pairs(rounded(cluster.similar_copies(docs(spark, d))))


QUERIES["title_pairs_similarity"] = title_pairs_similarity


@query
def event_clusters(spark, d):
    return cluster.clusters(docs(spark, d))


@query
def event_confidence(spark, d):
    rows = docs(spark, d).withColumn("cluster", F.expr("seq - seq % 5"))
    return cluster.build_events(rows, members=False).withColumns({c: F.array_join(c, ",") for c in ("url_hashes", "sources")}).drop("cluster")


@query
def post_label_merge(spark, d):
    told = cluster.merge_labelled(events(spark, d))
    return told.select("seq", "survivor", "event_date", "n_merged", "purpose", "n_members", "n_sources", "max_tier", "confidence", *[F.array_join(c, ",").alias(c) for c in ("sources", "url_hashes")])


@query
def governance_gate(spark, d):
    return governance.gate(orders(spark, d).where("governance_flag")).select("seq", "bucket", "penalty")


@query
def governance_once_per_type(spark, d):
    return governance.penalties(events(spark, d), day(ad.EV_AS_OF), dedupe=False).select("symbol", "seq", "event_type", "penalty", "eff")


@query
def governance_score(spark, d):
    rows = events(spark, d)
    return governance.governance(rows, rows, day(ad.EV_AS_OF), dedupe=False)


@query
def governance_running(spark, d):
    return governance.running_scores(governance.penalties(events(spark, d), day(ad.EV_AS_OF), dedupe=False))


@query
def governance_same_event(spark, d):
    rows = governance.gate(events(spark, d).where("governance_flag")).where("penalty is not null")
    return governance.same_events(rows)


@query
def governance_score_deduped(spark, d):
    rows = events(spark, d)
    return governance.governance(rows, rows, day(ad.EV_AS_OF))


@query
def unique_actions(spark, d):
    return actions.unique_actions(acts(spark, d)).select("symbol", "seq", "event_type")


@query
def action_event_score(spark, d):
    rows = actions.event_scores(acts(spark, d), day(ad.ACT_AS_OF))
    return rows.select("seq", "event_type", "stage", "stage_mult", "timing_mult", "size_mult", "score", "direction", "gate_a", "gate_b", "tracked_only")


@query
def action_risk_opportunity(spark, d):
    return actions.risk_opportunity(actions.event_scores(actions.unique_actions(acts(spark, d)), day(ad.ACT_AS_OF)))


@query
def action_bands(spark, d):
    rows = ad.view(spark, d, "SELECT p_partkey, p_partkey % 1001 AS hundredths FROM {part}").withColumn("score", F.col("hundredths") / 100.0)
    return rows.select("p_partkey", "hundredths", actions.action_band(F.col("score")).alias("band"), actions.action_band(F.col("score"), strict=True).alias("strict_band"))


@query
def quarantined_actions(spark, d):
    return actions.quarantined(actions.event_scores(acts(spark, d), day(ad.ACT_AS_OF)))


@query
def relative_zscores(spark, d):
    rows = sentiment.weighted_mean(orders(spark, d), day(ad.ORD_AS_OF), ["symbol"]).select("symbol", "weighted_mean")
    return sentiment.relative(rows, ["weighted_mean"])


@query
def price_returns_asof(spark, d):
    return market.returns(ad.view(spark, d, ad.PRICE), "2001-06-30")


@query
def realised_vol(spark, d):
    return market.volatility(ad.view(spark, d, ad.PRICE))


@query
def price_quadrant(spark, d):
    prices = ad.view(spark, d, ad.PRICE)
    bench = prices.groupBy("date").agg(F.max("close").alias("close")).select(F.lit(0).cast("long").alias("symbol"), "date", "close")
    signs = prices.select("symbol").distinct().withColumn("sentiment", (F.col("symbol") % 3).cast("int") - 1)
    return market.context(prices, bench, signs, "2001-06-30").select("symbol", "ret_1m", "bench_1m", "excess_1m", "quadrant")


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events dealt to four runs, with some in two of them, and the runs' manifests."""
    ev = events(spark, d).withColumn("event_id", F.col("seq"))
    first = ev.withColumn("run_id", F.concat(F.lit("run"), F.col("run").cast("string")))
    again = ev.where("seq % 3 = 0").withColumn("run_id", F.lit("run9")).withColumn("sentiment", -F.col("sentiment"))
    data = [("run0", "2024-01-05", "2024-01-05", "live"), ("run1", "2024-01-12", "2024-01-12", "live"), ("run2", "2024-01-19", "2024-02-19", "live"), ("run3", "2024-01-26", "2024-01-26", "pit-replay"), ("run9", "2024-01-28", "2024-01-28", "archive")]
    manifests = spark.createDataFrame(data, "run_id string, a string, f string, mode string").select("run_id", F.col("a").cast("date").alias("as_of"), F.col("f").cast("date").alias("fetched"), "mode")
    return first.unionByName(again), manifests


@query
def latest_copy(spark, d):
    return corpus.latest_copy(runs(spark, d)[0]).select("event_id", "run_id", "sentiment")


@query
def pit_visible_events(spark, d):
    ev, man = runs(spark, d)
    return corpus.visible_events(ev, man, day("2024-01-15")).select("event_id", "run_id", "event_date", "sentiment")


@query
def pit_visible_strict(spark, d):
    ev, man = runs(spark, d)
    return corpus.visible_events(ev, man, day("2024-01-22"), strict=True).select("event_id", "run_id", "sentiment")


@query
def backtest_weekly(spark, d):
    ev, man = runs(spark, d)
    mean = lambda rows, by: rows.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("sentiment").cast("double")).alias("mean"))
    return corpus.backtest(ev, man, "2024-01-03", "2024-01-31", 7, mean)


def stand_in(batch: list[dict]) -> str:
    """Stands for a model: it fails on a batch with a number that 97 divides and leaves out numbers that 13 divides."""
    if any(x["seq"] % 97 == 0 for x in batch):
        raise ValueError("this batch can't be read")
    said = [{"id": str(x["seq"]), "event_type": x["event_type"]} for x in batch if x["seq"] % 13 != 0]
    return f"The labels:\n```json\n{json.dumps(said)}\n```"


@query
def batched_labels(spark, d):
    rows = asking.asked(events(spark, d).select("seq", "event_type"), stand_in, "struct<event_type:string>")
    return rows.select("seq", "label.event_type", "label_error")


@query
def tolerant_replies(spark, d):
    """Replies of eight events each: in a code fence, in an object, broken off in the last label, after a stray bracket."""
    one = F.format_string('{"id": "%s", "event_type": "%s", "note": {"of": "a } and a \\"quote"}}', F.col("seq").cast("string"), F.col("event_type"))
    rows = events(spark, d).groupBy(F.floor(F.col("seq") / 8).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("one")))).alias("x"))
    said = F.array_join(F.transform("x", lambda x: x["one"]), ", ")
    form = F.col("block") % 4
    reply = (
        F.when(form == 0, F.concat(F.lit("Labels:\n```json\n["), said, F.lit("]\n```\nDone.")))
        .when(form == 1, F.concat(F.lit('{"labels": ['), said, F.lit("]}")))
        .when(form == 2, F.concat(F.lit("["), F.substr(said, F.lit(1), F.length(said) - 2)))
        .otherwise(F.concat(F.lit("See [note 1. ["), said, F.lit("] Regards")))
    )
    return asking.read_replies(rows.select("block", reply.alias("reply"))).select("block", "id", F.get_json_object("label", "$.event_type").alias("event_type"))


@query
def backtest_daily_sweep(spark, d):
    """Every day of a year, with results that veto: runs that come in, copies that are replaced, weights that fall."""
    ev, man = runs(spark, d)
    ev = ev.withColumns({"substance": F.lit("primary"), "pass_": F.lit("sentiment"), "confidence": (F.col("seq") % 7 / 8.0 + 0.25)})
    r = load_rubric({"sentiment": {"use_source_confidence": True, "plus_two_requires_no_results_offset": True}})
    spans = sweep.mean_intervals(ev, man, "2024-01-01", "2024-12-31", r)
    return sweep.at_dates(spans, "2024-01-01", "2024-12-31")


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, d)
    mean = lambda x: sentiment.weighted_mean(x, day(ad.ORD_AS_OF), ["symbol"]).select("symbol", "weighted_mean", F.col("weighted_band").cast("double").alias("band"))
    return mean(rows.where(ad.RUN_A)), mean(rows.where(ad.RUN_B))


@query
def run_delta(spark, d):
    now, before = halves(spark, d)
    return corpus.delta(now, before, ["weighted_mean"])


@query
def run_diff(spark, d):
    a, b = halves(spark, d)
    return corpus.diff(a, b, ["weighted_mean", "band"])


@query
def run_agreement(spark, d):
    a, b = halves(spark, d)
    return corpus.agreement(corpus.diff(a, b, ["weighted_mean", "band"]), ["band"])


@query
def run_merge(spark, d):
    rows = orders(spark, d)
    return corpus.merge(rows.where("seq % 2 = 0"), rows.where("seq % 2 <> 0 OR seq % 3 = 0")).select("symbol", "seq", "url")


@query
def run_verify(spark, d):
    """Stored scores of all rows against scores made again from rows of which some symbols lack some."""
    rows = orders(spark, d)
    mean = lambda x: sentiment.weighted_mean(x, day(ad.ORD_AS_OF), ["symbol"]).select("symbol", "weighted_mean")
    return corpus.verify(mean(rows), mean(rows.where(ad.RUN_AGAIN)), ["weighted_mean"]).select("symbol", "code")


@query
def penalty_changes(spark, d):
    pens = lambda x: governance.penalties(x, day(ad.EV_AS_OF), dedupe=False)
    rows = events(spark, d)
    return corpus.penalty_changes(pens(rows.where("seq % 2 = 0")), pens(rows.where("seq % 2 <> 0 OR seq % 3 = 0")))


@query
def label_cache_miss(spark, d):
    rows = docs(spark, d).withColumn("item_key", tx.url_hash(F.col("url")))
    return label.pending(rows, rows.where("seq % 5 = 0"), rows.where("seq % 7 = 0")).select("seq", "item_key")


@query
def label_from_cache(spark, d):
    rows = docs(spark, d)
    h = tx.url_hash(F.col("url"))
    items = rows.select("seq", tx.title_key(F.col("title")).alias("item_key"), h.alias("url_hash"), F.array(h, tx.url_hash(F.concat(F.lit("x"), F.col("url")))).alias("member_hashes"))
    cache = rows.where("seq % 4 = 0").groupBy(tx.title_key(F.col("title")).alias("item_key")).agg(F.min("seq").cast("string").alias("label"))
    index = rows.where("seq % 5 = 1").groupBy(F.when(F.col("seq") % 2 == 0, h).otherwise(tx.url_hash(F.concat(F.lit("x"), F.col("url")))).alias("url_hash")).agg(F.min("seq").cast("string").alias("label"))
    return label.from_cache(items, cache, index).select("seq", "label", "label_source")


@query
def corpus_union(spark, d):
    rows = events(spark, d).select("symbol", F.col("seq").alias("event_id"), "event_date", "governance_flag", F.array(tx.url_hash(F.col("url"))).alias("url_hashes"))
    return corpus.missing_events(rows.where("event_id % 6 = 0"), rows.where("event_id % 6 <> 0"), day(ad.EV_AS_OF), 20).select("symbol", "event_id")


@query
def universe_added_removed(spark, d):
    rows = ad.view(spark, d, "SELECT c_name AS symbol, c_custkey FROM {customer}")
    return corpus.universe_changes(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 <> 0 OR c_custkey % 3 = 0"))


@query
def universe_hash(spark, d):
    return corpus.universe_hash(ad.view(spark, d, "SELECT n_name AS symbol FROM {nation}"))


@query
def drop_counts_total(spark, d):
    rows = sample.drop_reasons(sample.stratified(docs(spark, d), day(ad.DOC_AS_OF))).where("reason is not null")
    return score.drop_totals(rows)


def portfolio(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d)
    holdings = rows.groupBy("symbol").agg(F.min("sector").alias("sector"))
    return score.score_portfolio(holdings, rows, day(ad.ORD_AS_OF))


@query
def score_portfolio(spark, d):
    return portfolio(spark, d)


@query
def score_workings(spark, d):
    rows = orders(spark, d)
    return score.workings(rows, rows, day(ad.ORD_AS_OF))


@query
def portfolio_facts(spark, d):
    return score.portfolio_facts(portfolio(spark, d))


@query
def label_split(spark, d):
    gov = lambda x: governance.governance(x, x, day(ad.EV_AS_OF), dedupe=False)
    rows = events(spark, d)
    return score.label_split(gov(rows.where("seq % 2 = 0")), gov(rows.where("seq % 2 <> 0 OR seq % 3 = 0")))


@query
def narration(spark, d):
    return score.narration(portfolio(spark, d), sentiment.drivers(orders(spark, d), day(ad.ORD_AS_OF)))


@query
def anomaly_proposals(spark, d):
    rows = orders(spark, d)
    applied = governance.penalties(rows, day(ad.ORD_AS_OF))
    standard = sentiment.evidence_standard(rows, ["symbol"])
    drops = rows.select("symbol", F.when(F.col("seq") % 10 < F.col("holding_seq") % 10, "not_about_company").otherwise("empty_rationale").alias("reason"))
    labelled = rows.withColumn("labelled", ~((F.col("seq") % 7 == 0) & (F.col("holding_seq") % 3 == 0)))
    verified = rows.where("penalty_override is not null")
    other = governance.governance(rows, rows, day(ad.ORD_AS_OF), dedupe=False)
    return score.anomalies(portfolio(spark, d), applied, rows.where("penalty_override is null"), labelled, standard, drops=drops, linted=rows.where("event_type = 'price_move'"), verified=verified, against=other)


@query
def review_queue(spark, d):
    risk = actions.risk_opportunity(actions.event_scores(actions.unique_actions(acts(spark, d)), day(ad.ACT_AS_OF)))
    weights = ad.view(spark, d, "SELECT p_partkey AS symbol, p_retailprice AS weight FROM {part}")
    return actions.review_queue(risk, weights)


@query
def view_scorecard(spark, d):
    out = views.scorecard(portfolio(spark, d), day(ad.ORD_AS_OF))
    return out.select("symbol", "sentiment_band", "governance_score", "sentiment_mean_z", "governance_score_z", "risk_score_z", "as_of")


@query
def view_articles(spark, d):
    """Each group of five documents is one event here, told by its first kept row."""
    rows = sample.drop_reasons(sample.stratified(docs(spark, d), day(ad.DOC_AS_OF)))
    kept = rows.where("reason is null").withColumn("survivor", F.min("seq").over(Window.partitionBy("symbol", F.floor(F.col("seq") / 5))))
    return views.articles_by_window(kept.where("seq = survivor"), rows.where("reason is not null"), kept.where("seq <> survivor")).select("symbol", "seq", "win", "state", "why")


@query
def view_governance(spark, d):
    return views.governance_evidence(events(spark, d), day(ad.EV_AS_OF)).select("symbol", "seq", "event_type", "state", "penalty", "eff")


@query
def view_actions(spark, d):
    return views.action_events(acts(spark, d), day(ad.ACT_AS_OF)).select("symbol", "seq", "state", "severity_points", "stage", "score", "direction", "gate_a")


@query
def view_coverage(spark, d):
    rows = sample.drop_reasons(sample.stratified(docs(spark, d), day(ad.DOC_AS_OF)))
    return views.coverage_rows(rows.where("reason is null"), rows.where("reason is not null"), docs(spark, d))


@query
def view_balance(spark, d):
    return views.balance(orders(spark, d), day(ad.ORD_AS_OF))


@query
def view_payload(spark, d):
    return views.payload(orders(spark, d), portfolio(spark, d), day(ad.ORD_AS_OF))
