"""Running sums over dates and prefix-filtered pairs, each against plain loops."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import cluster, corpus, sentiment, sweep
from tidemark.plans.rubric import DEFAULT, load_rubric
from pyspark.sql import functions as F

EVENT = "event_id string, run_id string, symbol string, event_date date, published date, kind string, event_type string, sentiment int, confidence double, substance string, pass_ string"
MANIFEST = "run_id string, as_of date, fetched date, mode string"


def copies(seed, n=120):
    rng = random.Random(seed)
    day = lambda span: date(2024, 1, 1) + timedelta(days=rng.randrange(span))
    types = ["earnings_miss", "order_win", "other", "price_move", "regulatory_action", "earnings_beat"]
    rows = []
    for k in range(n):
        first = day(500)
        for run in rng.sample(range(6), rng.choice([1, 1, 2, 3])):
            at = rng.choice([first, first, first + timedelta(days=rng.randrange(40)), None]) if k % 11 == 0 else first
            said = rng.choice([at, first, first - timedelta(days=rng.randrange(100)), None if k % 7 == 0 else first])
            rows.append((f"e{k}", f"r{run}", "ABC"[k % 3], at, said, "news", rng.choice(types), rng.randrange(-2, 3), rng.choice([None, 0.1, 0.7, 0.85]), rng.choice(["primary", None, "passing"]), rng.choice([None, "results"])))
    # runs' names don't follow their dates, one has no date of fetching, one is a replay
    runs = [("r0", date(2024, 3, 1), date(2024, 3, 1), "live"), ("r1", date(2024, 2, 1), date(2024, 6, 1), "live"), ("r2", date(2024, 7, 1), date(2024, 7, 2), None)]
    runs += [("r3", date(2024, 5, 1), None, "live"), ("r4", date(2024, 5, 5), date(2024, 5, 5), "pit-replay"), ("r5", date(2024, 12, 1), date(2024, 12, 1), "archive")]
    return rows, runs


RUBRICS = [{}, {"use_source_confidence": True, "plus_two_requires_no_results_offset": True, "minus_one_when_results_negative": True, "results_dominance_threshold": 0.01, "min_signal_events": 2}]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("change", RUBRICS)
def test_sweep_equals_the_backtest_of_every_day(spark, change, strict):
    r = load_rubric({"sentiment": change})
    rows, runs = copies(len(change) + strict)
    ev, man = spark.createDataFrame(rows, EVENT), spark.createDataFrame(runs, MANIFEST)
    start, end = "2024-01-15", "2025-08-01"
    score = lambda seen, by: sentiment.weighted_mean(seen.withColumn("as_of", F.col("as_of")), F.col("as_of"), [*by, "symbol"], r)
    want = corpus.backtest(ev, man, start, end, 1, score, r, strict)
    spans = sweep.mean_intervals(ev, man, start, end, r, strict=strict).cache()
    key = lambda d: {(x.as_of, x.symbol): (x.n_events, x.n_signal, round(x.weighted_mean, 9), x.weighted_band) for x in d.collect()}
    want, got = key(want), key(sweep.at_dates(spans, start, end))
    assert got.keys() == want.keys() and len(got) > 900
    assert all(g[:2] == want[k][:2] and g[2] == pytest.approx(want[k][2], abs=1e-8) for k, g in got.items())
    # a band may differ only where a mean lies on its edge
    edges = [abs(v) for v in DEFAULT["sentiment"]["band_cutoffs"].values()]
    assert all(g[3] == want[k][3] or min(abs(abs(g[2]) - e) for e in edges) < 1e-8 for k, g in got.items())
    weekly = key(sweep.at_dates(spans, start, end, 7))
    assert weekly == {k: v for k, v in got.items() if (k[0] - date(2024, 1, 15)).days % 7 == 0}
    # rows follow events and windows, not dates
    assert spans.count() <= 2 * len(rows) * 4 < len(got) * 4


def test_sweep_of_nothing_and_of_half_lives(spark):
    ev, man = spark.createDataFrame([], EVENT), spark.createDataFrame([], MANIFEST)
    assert sweep.at_dates(sweep.mean_intervals(ev, man, "2024-01-01", "2024-02-01"), "2024-01-01", "2024-02-01").count() == 0
    with pytest.raises(ValueError, match="half-life"):
        sweep.mean_intervals(ev, man, "2024-01-01", "2024-02-01", load_rubric({"sentiment": {"window_weights": None}}))


def titles(seed, n=420):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    hot = ["hotone", "hottwo", "hotthree"]
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out)[3].split()
            rng.shuffle(base)
            text = " ".join(base[: rng.randrange(1, len(base) + 1)] + rng.sample(words, rng.randrange(3)))
        else:
            text = " ".join(rng.sample(words, rng.randrange(1, 9)) + rng.sample(hot, rng.randrange(4)))
        out.append((k, "XY"[k % 2], date(2024, 1, 1) + timedelta(days=rng.randrange(25)), text))
    return out


def plain_pairs(rows, r):
    c = r["cluster"]
    sets = {k: set(t.split()) for k, _, _, t in rows}
    n = {}
    for k, s, _, _ in rows:
        for w in sets[k]:
            n[s, w] = n.get((s, w), 0) + 1
    top = {s: {w for _, w in sorted((-m, w) for (x, w), m in n.items() if x == s)[: c["top_tokens"]]} for s in "XY"}
    out = set()
    for a, s, d, _ in rows:
        for b, s2, d2, _ in rows:
            if a < b and s == s2:
                both, gap, small = sets[a] & sets[b], abs((d - d2).days), min(len(sets[a]), len(sets[b]))
                j, held, shared = len(both) / len(sets[a] | sets[b]), len(both) / small, len(both - top[s])
                near = gap <= c["near_days"] and (j >= c["near_jaccard"] or (held >= c["contained"] and small >= c["contained_size"]))
                if near or (gap <= c["days"] and (j >= c["jaccard"] or shared >= c["shared"])):
                    out.add((a, b, gap, round(j, 9), round(held, 9), shared, near))
    return out


@pytest.mark.parametrize("top", [0, 5, 200])
def test_prefixes_lose_no_pair(spark, top, monkeypatch):
    r = load_rubric({"cluster": {"top_tokens": top}})
    rows = titles(top)
    items = spark.createDataFrame(rows, "seq long, symbol string, published date, title string")
    want = plain_pairs(rows, r)
    for split in (cluster.SPLIT, 7):  # a frequent token in parts
        monkeypatch.setattr(cluster, "SPLIT", split)
        got = [(x.a, x.b, x.gap, round(x.jaccard, 9), round(x.contained, 9), x.shared, x.near) for x in cluster.similar_pairs(items, r).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def flood(n=120):
    """Copies of a title over some days, one of them a month later, and of a title like it."""
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    rows = [(k, "X", day(k % 9), "delta alpha gamma beta omega") for k in range(n)]
    rows += [(n + k, "X", day(20 + k % 2), "alpha beta gamma delta sigma") for k in range(n)]
    rows += [(2 * n, "X", day(60), "omega beta gamma delta alpha"), (2 * n + 1, "Y", day(1), "omega beta gamma delta alpha"), (2 * n + 2, None, day(1), "omega beta gamma delta alpha")]
    return [*rows, (2 * n + 3, "X", day(22), "alpha beta gamma delta kappa"), (2 * n + 4, "X", None, "alpha"), (2 * n + 5, "X", day(3), None)]


def test_copies_are_one_node_of_the_links(spark, monkeypatch):
    rows = flood()
    items = spark.createDataFrame(rows, "seq long, symbol string, published date, title string")
    seen = []
    plain = cluster.components
    monkeypatch.setattr(cluster, "components", lambda edges, *a: (seen.append(edges.count()), plain(edges, *a))[1])
    got = {x.seq: x.cluster for x in cluster.clusters(items).collect()}
    assert seen[0] < 10  # 120 * 119 pairs of copies and more
    assert got == {k: 0 if k < 120 else 120 if k < 240 or k == 243 else k for k in range(246)}


@pytest.mark.parametrize("days", [(2, 7), (9, 4)])
def test_titles_meet_once_whatever_their_copies(spark, days, monkeypatch):
    r = load_rubric({"cluster": {"days": days[0], "near_days": days[1], "top_tokens": 3}})
    rows = flood(40)
    items = spark.createDataFrame(rows, "seq long, symbol string, published date, title string")
    seen = []
    plain = cluster.meetings
    monkeypatch.setattr(cluster, "meetings", lambda *a: (seen.append(plain(*a).count()), plain(*a))[1])
    got = [(x.a, x.b, x.gap, round(x.jaccard, 9), round(x.contained, 9), x.shared, x.near) for x in cluster.similar_pairs(items, r).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs([x for x in rows if None not in x], r) and len(got) > 1000
    assert sum(seen) < 20  # 40 * 39 pairs of copies and more


def test_pairs_of_copies_are_made_in_bounded_tasks(spark, monkeypatch):
    rows = flood(90)
    items = spark.createDataFrame(rows, "seq long, symbol string, published date, title string")
    monkeypatch.setattr(cluster, "COPIES", 4, raising=False)
    monkeypatch.setattr(cluster, "PAIRS", 200, raising=False)
    got = cluster.similar_pairs(items).withColumn("task", F.spark_partition_id()).collect()
    pairs = [(x.a, x.b, x.gap, round(x.jaccard, 9), round(x.contained, 9), x.shared, x.near) for x in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs([x for x in rows if None not in x], DEFAULT) and len(pairs) > 5000
    tasks = [x.task for x in got]
    assert max(tasks.count(k) for k in set(tasks)) < 1000  # a few kilobytes of copies, which were one task or two


@pytest.mark.parametrize("strict", [False, True])
def test_copies_seen_at_a_date_against_loops(spark, strict):
    """Views and backtests against a loop over copies; no row is dealt by run, of which there are few."""
    rows, runs = copies(7)
    ev, man = spark.createDataFrame(rows, EVENT), spark.createDataFrame(runs, MANIFEST)

    def seen(at):
        limit = at + timedelta(days=DEFAULT["pit_grace_days"])
        open_ = {r for r, a, f, mode in runs if a <= limit and mode != "pit-replay" and (not strict or (f and f <= limit))}
        told = {}
        for x in sorted(rows, key=lambda x: x[1]):
            if x[1] in open_ and x[3] and x[3] <= at:
                told[x[0]] = x
        return set(told.values())

    back = corpus.backtest(ev, man, "2024-01-15", "2025-08-01", 60, lambda x, by: x.select(*by, *ev.columns), strict=strict)
    got = {}
    for r in back.collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    for k in range(10):
        at = date(2024, 1, 15) + timedelta(days=60 * k)
        view = corpus.visible_events(ev, man, F.lit(at), strict=strict)
        assert sorted(got.get(at, []), key=str) == sorted(seen(at), key=str) == sorted(map(tuple, view.select(*ev.columns).collect()), key=str)
    for df in (back, view, sweep.lives(ev, man, strict=strict)):
        assert "hashpartitioning(run_id" not in df._jdf.queryExecution().executedPlan().toString()
