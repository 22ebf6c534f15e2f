"""Scores of hand-made rows against numbers worked out by hand."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timing
from tidemark.operators import actions, governance, sentiment
from tidemark.plans.rubric import load_rubric

DAY = date(2026, 7, 1)


def as_of():
    return F.lit("2026-07-01").cast("date")


GOV = "symbol string, seq long, event_type string, published date, title string, rationale string, governance_flag boolean, historical boolean, materiality string, action_stage string, event_key string, penalty_override double"


def gov_rows(spark, rows):
    """(event_type, days old, title, and others by name) as flagged rows of one company."""
    out = []
    for k, (et, old, title, kw) in enumerate(rows):
        out.append(("AA", k, et, DAY - timedelta(days=old), title, "", True, kw.get("historical", False), kw.get("materiality"), kw.get("stage"), kw.get("key"), kw.get("override")))
    return spark.createDataFrame(out, GOV)


def score(spark, rows):
    df = gov_rows(spark, rows)
    holdings = spark.createDataFrame([("AA", "x")], "symbol string, sector string")
    r = governance.governance(df, holdings, as_of()).first()
    return r.governance_score, r.governance_label


EXIT = "CFO resigns over dispute"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], (100, "Clean")),
        ([("regulatory_action", 5, "order one", {}), ("management_exit", 20, EXIT, {})], (72, "Flag")),
        ([("auditor_restatement", 5, "t", {})], (75, "Flag")),
        ([("exchange_fine", 5, "t", {"materiality": "high"})], (90, "Watch")),
        ([("exchange_fine", 5, "t", {})], (93, "Watch")),
        ([("rpt_concern", 400, "a", {"historical": True}), ("investigation", 500, "b", {"historical": True})], (95, "Clean")),
        ([("regulatory_action", 5, "a", {}), ("regulatory_action", 400, "b", {"historical": True})], (80, "Watch")),
        ([("regulatory_action", 30, "t", {})], (80, "Watch")),
        ([("regulatory_action", 365, "t", {})], (90, "Watch")),
        ([("regulatory_action", 5, "t", {"stage": "notice_or_demand"})], (90, "Watch")),
        ([("regulatory_action", 5, "t", {"stage": "resolved_or_quashed"})], (100, "Clean")),
        ([("regulatory_action", 16, "food regulator notice over noodles quality", {"stage": "notice_or_demand"}), ("investigation", 15, "food regulator probe noodles quality", {})], (90, "Watch")),
        ([("regulatory_action", 9, "market watchdog settles insider matter", {}), ("investigation", 5, "tax office raids warehouse", {})], (70, "Flag")),
        ([("management_exit", 5, "Board appoints new CFO", {})], (100, "Clean")),
        ([("management_exit", 5, "Vice president quits", {})], (100, "Clean")),
        ([("pledge", 5, "t", {"override": -3.0})], (97, "Clean")),
    ],
)
def test_governance(spark, rows, want):
    assert score(spark, rows) == want


def test_same_event_is_greedy(spark):
    """Against a loop over the rows, most severe first."""
    rng = random.Random(2)
    words = ["alpha", "bravo", "carbon", "delta", "eagle", "foxtrot"]
    rows = [(rng.choice(["regulatory_action", "investigation", "exchange_fine", "rpt_concern"]), rng.randrange(40), " ".join(rng.sample(words, 3)), {"key": rng.choice([None, None, "k1", "k2"])}) for _ in range(60)]
    df = governance.gate(gov_rows(spark, rows)).where("penalty is not null")
    got = {r.seq: r.dup_of for r in governance.same_events(df).collect()}
    data = sorted(df.collect(), key=lambda r: (r.penalty, r.published, r.seq))
    family = {"rpt_concern": "rpt"}
    kept, want = [], {}
    for r in data:
        w = set(r.title.split()) | ({r.event_key} if r.event_key and len(r.event_key) > 3 else set())
        for q, u in kept:
            gap = abs((r.published - q.published).days)
            if family.get(r.event_type, "reg") != family.get(q.event_type, "reg") or gap > 7:
                continue
            n = len(w & u)
            if (r.event_key and r.event_key == q.event_key) or (n >= 2 and (n / min(len(w), len(u)) >= 0.5 or gap <= 3)):
                want[r.seq] = q.seq
                break
        else:
            kept.append((r, w))
    assert got == want


def test_window_weights(spark):
    ages = [0, 30, 31, 90, 91, 180, 181, 365]
    rows = spark.createDataFrame([(a, DAY - timedelta(days=a)) for a in ages], "age int, d date")
    got = [r.w for r in rows.select("age", timing.recency_weight(F.col("d"), as_of()).alias("w")).orderBy("age").collect()]
    assert got == [1, 1, 0.75, 0.75, 0.5, 0.5, 0.25, 0.25]


def test_whole_numbers_and_points(spark):
    xs = [-0.42, 0.5, 1.6, -0.5, 1.49]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    got = rows.orderBy("k").select(sentiment.to_integer(F.col("x")).alias("i"), sentiment.to_points(F.col("x")).alias("p"), sentiment.band(F.col("x")).alias("b")).collect()
    assert [r.i for r in got] == [0, 1, 2, -1, 1]
    assert [r.p for r in got] == [-21, 25, 80, -25, 74]
    assert [r.b for r in got] == [0, 1, 2, -1, 1]


EV = "symbol string, seq long, kind string, event_type string, sentiment int, substance string, confidence double, pass_ string, win int, published date, url string"


def ev_rows(spark, rows):
    return spark.createDataFrame([("AA", k, "news", et, s, "primary", c, "", w, DAY - timedelta(days=old), f"http://x/{k}") for k, (et, s, c, w, old) in enumerate(rows)], EV)


def test_zeros_count_only_without_signal(spark):
    few = ev_rows(spark, [("order_win", 1, None, 1, 1), ("order_win", 0, None, 1, 1)])
    many = ev_rows(spark, [("order_win", 1, None, 1, 1)] * 2 + [("order_win", -2, None, 1, 100), ("order_win", 0, None, 1, 1)])
    assert sentiment.weighted_mean(few, as_of(), ["symbol"]).first().weighted_mean == 0.5
    assert sentiment.weighted_mean(many, as_of(), ["symbol"]).first().weighted_mean == pytest.approx((2 - 1) / 2.5)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("order_win", 1, None, 1, 1)] * 5, "only 5 article(s)"),
        ([("order_win", 1, None, 1, 1)] * 8, "no results item"),
        ([("earnings_beat", 1, None, 1, 1)] * 8, ""),
        ([("order_win", 1, 0.5, 1, 1)] * 5, "only 5 event(s)"),
        ([("order_win", 1, 0.5, 1, 1)] * 6, "only 1 window(s)"),
        ([("order_win", 1, 0.5, 1 + k % 2, 1) for k in range(6)], "no results event"),
    ],
)
def test_evidence_standard(spark, rows, want):
    assert sentiment.evidence_standard(ev_rows(spark, rows), ["symbol"]).first().insufficient == want


def test_price_moves_never_count(spark):
    assert sentiment.evidence_standard(ev_rows(spark, [("price_move", 2, None, 1, 1)] * 10), ["symbol"]).count() == 0


ACT = "symbol string, seq long, event_type string, sentiment int, published date, title string, ca_stage string, ca_size_pct double, ca_days_to_effective double, severity string, materiality string, substance string"


def test_action_score_worked_example(spark):
    """An issue of 6 x 0.6 x 1.0 x 1.2, a pledge of 7 x 0.7 and an exit of 6 x 0.8 leave a risk of 8.5."""
    rows = [
        ("AA", 0, "dilution", -1, DAY, "a 1", "board_approved", 8.0, 10.0, None, None, None),
        ("AA", 1, "pledge", -1, DAY, "b 2", "other", 1.0, 10.0, None, None, None),
        ("AA", 2, "management_exit", 0, DAY, "c 3", "approval_obtained", None, 10.0, None, None, None),
        ("AA", 3, "dividend", 1, DAY, "d 4", "completed", None, 10.0, None, None, None),
        ("AA", 4, "index_inclusion", 1, DAY, "e 5", None, None, None, None, None, None),
        ("AA", 5, "rights_issue", -1, DAY, "f 6", None, None, None, None, None, None),
    ]
    r = load_rubric({"actions": {"stage_multiplier": {"other": 1.0}}})
    scored = actions.event_scores(spark.createDataFrame(rows, ACT), as_of(), r)
    got = {x.seq: round(x.score, 2) for x in scored.where("score is not null").collect()}
    assert got[0] == 4.32 and got[1] == 4.9 and got[2] == 4.8
    risk = actions.risk_opportunity(scored, r).first()
    assert round(risk.risk_score, 1) == 8.5 and risk.risk_band == "Act"
    assert (risk.n_scored, risk.n_quarantined, risk.n_tracked) == (3, 1, 2)


def test_bands_meet_unless_strict(spark):
    row = spark.range(1).select(actions.action_band(F.lit(2.95)).alias("a"), actions.action_band(F.lit(2.95), strict=True).alias("b")).first()
    assert (row.a, row.b) == ("Log", "Exit")


def test_repeated_actions(spark):
    rows = [("AA", k, "dividend", 1, DAY - timedelta(days=d), "Dividend of Rs 5", None, None, None, None, None, None) for k, d in enumerate([200, 100, 0, 400])]
    assert {x.seq for x in actions.unique_actions(spark.createDataFrame(rows, ACT)).collect()} == {3, 0}
    assert {x.seq for x in actions.unique_actions(spark.createDataFrame([(*r[:2], "buyback", *r[3:]) for r in rows], ACT)).collect()} == {0, 1, 2, 3}


def test_rubric_overrides_change_the_hash():
    a, b = load_rubric(), load_rubric({"governance": {"penalties": {"pledge": {"low": -1}}}})
    assert a.sha != b.sha and b["governance"]["penalties"]["pledge"] == {"low": -1, "medium": -5, "high": -10}
    assert a["governance"]["penalties"]["pledge"]["low"] == 0


def test_rounding_is_the_double_s_own(spark):
    """Against the language's own rounding, exact halves and near halves included."""
    from tidemark.functions.rounding import half_even

    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 1.005, 2.5, 9.995, 0.0, 10.0, 4.35, -2.675, -0.125, *[k / 1000 + 0.005 for k in range(3000)], *[rng.random() * 10 for _ in range(3000)], *[k / 8 for k in range(90)]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)] + [(-1, None)], "k long, x double").withColumn("y", half_even(F.col("x"))).collect()
    assert all(r.y == (None if r.x is None else round(r.x, 2)) for r in rows)


ACTS = "symbol string, seq long, published date, event_type string, title string, sentiment int, kind string"


def test_an_undated_action_stands_for_all_of_its_kind(spark):
    day = lambda s: date.fromisoformat(s) if s else None
    rows = [("A", 1, None), ("A", 2, "2024-01-01"), ("A", 3, "2024-12-01"), ("B", 4, "2024-01-01"), ("B", 5, "2024-01-20"), ("B", 6, "2024-03-30"), ("C", 7, None), ("C", 8, None)]
    df = spark.createDataFrame([(s, k, day(d), "buyback", "Buyback of Rs 5", 1, "news") for s, k, d in rows], ACTS)
    assert sorted(r.seq for r in actions.unique_actions(df).collect()) == [1, 4, 6, 7]


def test_action_scores_by_hand(spark):
    """Each event's score and the combined one have two places: 1 - (1 - .38)(1 - .24)(1 - .2) and the like."""
    rows = [("A", 1, 0, "dividend", "Rs 1"), ("A", 2, 40, "pledge", "Rs 2"), ("A", 3, 100, "buyback", "Rs 3"), ("B", 4, 10, "dilution", "Rs 4")]
    df = spark.createDataFrame([(s, k, DAY - timedelta(days=old), et, t, -1, "news") for s, k, old, et, t in rows], ACTS)
    scored = actions.event_scores(df, as_of())
    got = {r.seq: r.score for r in scored.collect()}
    # severity x stage (board approved 0.6) x timing (0.5 ^ (age / half-life), 0.1 at least) x size 1
    want = {1: round(4 * 0.6, 2), 2: round(7 * 0.6 * 0.5 ** (40 / 180), 2), 3: round(5 * 0.6 * max(0.1, 0.5 ** (100 / 30)), 2), 4: round(6 * 0.6 * 0.5 ** (10 / 90), 2)}
    assert got == want
    risk = {r.symbol: r.risk_score for r in actions.risk_opportunity(scored).collect()}
    both = (1 - want[3] / 10) * (1 - want[2] / 10) * (1 - want[1] / 10)
    assert risk == {"A": round(10 * (1 - both), 2), "B": round(10 * (1 - (1 - want[4] / 10)), 2)}
