import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine, run_id
from tidemark.operators import learn, views
from tidemark.sources import sinks

DAY = date(2026, 7, 1)
ITEMS = "symbol string, seq long, title string, snippet string, url string, source string, published date"


@pytest.fixture(scope="module")
def data(spark):
    holdings = spark.createDataFrame([("AA", "Acme Forge", "Steel", ""), ("BB", "Bolt Works", "Tools", "bolts"), ("CC", "Quiet Corp", "Tools", "")], "symbol string, name string, sector string, aliases string")
    rows, k = [], 0
    for sym, name in (("AA", "Acme"), ("BB", "Bolt")):
        for d in range(0, 360, 12):
            what = ["profit jumps on strong demand", "wins order for rail parts", "misses estimates as costs rise", "expansion plan cleared"][d // 12 % 4]
            rows.append((sym, k, f"{name} {what} season{d}", "", f"http://reuters.com/{k}", "reuters.com", DAY - timedelta(days=d)))
            k += 1
    rows.append(("AA", k, "Acme CFO resigns abruptly", "", f"http://livemint.com/{k}", "livemint.com", DAY - timedelta(days=9)))
    for j in range(8):
        rows.append(("BB", k + 1 + j, f"Bolt gets regulator penalty order over drainage plant outlet{j}", "", f"http://x{j}.com/p", f"x{j}.com", DAY - timedelta(days=20 + j % 2)))
    rows.append(("AA", k + 20, "Market closes higher", "", "http://x.com/1", "x.com", DAY))
    return holdings, spark.createDataFrame(rows, ITEMS)


def test_run_replay_verify_and_merge(spark, data, tmp_path):
    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/corpus")
    out = e.run(holdings, items, "2026-07-01", run="2026-07-01_a")
    got = {r.symbol: r for r in out.scores.collect()}
    assert got["AA"].governance_score == 92 and got["BB"].governance_score == 80 and got["CC"].governance_score == 100
    assert got["AA"].sentiment_mean is not None and got["CC"].note == "no evidence" and got["CC"].low_confidence
    flood = out.evidence.where("symbol = 'BB' and event_type = 'regulatory_action'").collect()
    assert len(flood) == 1 and flood[0].n_members == 8
    assert out.dropped.where("reason = 'title does not name the company'").count() == 1
    assert e.verify("2026-07-01_a", holdings, "2026-07-01").count() == 0
    again = {r.symbol: r.sentiment_mean for r in e.replay(holdings, "2026-07-01").collect()}
    assert again == {s: r.sentiment_mean for s, r in got.items()}
    e.run(holdings, items.where("published < DATE '2026-06-25'"), "2026-07-01", run="2026-07-02_b")
    changed = {r.symbol: r.code for r in e.diff("2026-07-01_a", "2026-07-02_b").collect()}
    assert changed["CC"] == "=" and "C" in changed.values()
    merged = {r.symbol: r.governance_score for r in e.merge("2026-07-01_a", "2026-07-02_b", holdings, "2026-07-01").collect()}
    assert merged == {s: r.governance_score for s, r in got.items()}
    with pytest.raises(ValueError, match="already"):
        e.run(holdings, items, "2026-07-01", run="2026-07-01_a")
    test = e.backtest("2026-06-24", "2026-07-01")
    seen = {(r.as_of, r.symbol): r.n_events for r in test.collect()}
    assert seen[(date(2026, 7, 1), "BB")] >= seen.get((date(2026, 6, 24), "BB"), 0)
    new = e.relabel("2026-07-01_a", lambda d: d.withColumn("label", F.struct(F.lit("other").alias("event_type"), F.lit(0).alias("sentiment"))), holdings)
    assert {r.event_type for r in new.collect()} == {"other"} and new.where("severity is not null").count() > 0


def test_unused_weight_changes_nothing_else(spark, data, tmp_path):
    from tidemark.plans.rubric import load_rubric

    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/c")
    base = {r.symbol: r for r in e.run(holdings, items, "2026-07-01", run="a").scores.collect()}
    e.r = load_rubric({"governance": {"penalties": {"management_exit": -30}}})
    other = {r.symbol: r for r in e.rescore("a", holdings, "2026-07-01").collect()}
    assert other["AA"].governance_score == base["AA"].governance_score - 22
    assert other["BB"] == base["BB"] and other["CC"] == base["CC"]


def test_golden(spark, tmp_path):
    cases = [("g1", "penalise", -20.0, "regulatory_action", "company", "x fined"), ("g2", "reject", None, "regulatory_action", "victim", "y"), ("g3", "reject", None, "management_exit", "company", "New CFO appointed")]
    df = spark.createDataFrame(cases, "id string, expected string, expected_weight double, event_type string, subject string, title string")
    assert all(r.ok for r in Engine(spark, f"file://{tmp_path}").golden(df).collect())


def test_lessons(spark):
    found = spark.createDataFrame([("loose_query", "AA", "L-1"), ("many_flags", "portfolio", "L-2")], "kind string, key string, lesson_id string")
    reg = learn.propose(found, spark.createDataFrame([], learn.REGISTRY))
    assert learn.propose(found, reg).count() == 2
    base = learn.patched(reg).sha
    reg = learn.decide(reg, "L-1", "rejected")
    assert learn.patched(reg).sha == base
    reg = learn.decide(reg, "L-2", "accepted", {"low_below_items": 4})
    assert learn.patched(reg)["low_below_items"] == 4 and learn.patched(reg).sha != base
    assert {r.status: r.n for r in learn.status(reg).collect()} == {"accepted": 1, "rejected": 1}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("AA", 1.0, [1, 2])], "symbol string, score double, parts array<int>")
    path = f"file://{tmp_path}/run"
    sinks.machine_outputs(path, s, s, s, {"as_of": "2026-07-01"})
    scores, _, meta = sinks.read_run(spark, path, "symbol string, score double, parts array<int>", "symbol string")
    assert scores.first() == s.first() and meta == {"as_of": "2026-07-01"}
    files = sinks.manifest(spark, path).collect()
    assert files and all(len(f.sha256) == 64 for f in files)
    items = spark.createDataFrame([("k1", "AA", "t", "", "u"), ("k2", "AA", "t", "", "u")], "item_key string, symbol string, title string, snippet string, url string")
    sinks.write_pending(items, f"file://{tmp_path}/pending")
    assert spark.read.json(f"file://{tmp_path}/pending").count() == 2
    (tmp_path / "labels.json").write_text("\n".join(json.dumps({"item_key": "k1", "label": {"event_type": x}}) for x in ("a", "b")) + "\nnot json\n")
    got = sinks.read_labels(spark, f"file://{tmp_path}/labels.json", "struct<event_type:string>").collect()
    assert [(r.item_key, r.label.event_type) for r in got] == [("k1", "b")]
    sinks.append_labels(items, None, f"file://{tmp_path}/cache")
    sinks.append_labels(items, spark.read.parquet(f"file://{tmp_path}/cache"), f"file://{tmp_path}/cache")
    assert spark.read.parquet(f"file://{tmp_path}/cache").count() == 2


def test_name_tokens(spark, data):
    got = {r.symbol: set(r.name_tokens) for r in views.name_tokens(data[0]).collect()}
    assert got["BB"] == {"bb", "bolts", "bolt", "works"} and "acme forge ltd" in got["AA"] and "forge" in got["AA"]


def test_run_id():
    from datetime import datetime

    assert run_id("2026-07-01", datetime(2026, 7, 3, 1, 2, 3, 4000)) == "2026-07-01_20260703T010203004"


def counting(asked):
    """The keyword labeller, which notes how many rows it is asked for."""
    from tidemark.engine import keyword_labeller

    def labeller(rows):
        n = rows.count()
        if n:
            asked.append(n)
        return keyword_labeller(rows)

    return labeller


def test_a_second_run_labels_nothing(spark, data, tmp_path):
    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/c")
    asked = []
    first = e.run(holdings, items, "2026-07-01", counting(asked), run="a")
    assert len(asked) == 1 and asked[0] > 10
    again = e.run(holdings, items, "2026-07-01", counting(asked), run="b")
    assert len(asked) == 1
    assert sorted(map(str, first.scores.collect())) == sorted(map(str, again.scores.collect()))
    assert e.previous() == "b" and e.previous("b") == "a"
    assert {r.symbol: r.drivers for r in e.drivers("a", "b", "2026-07-01").collect()} == {"AA": "agree", "BB": "agree", "CC": "agree"}
    # another prompt's labels don't count
    e.run(holdings, items, "2026-07-01", counting(asked), run="c", prompt="v2")
    assert len(asked) == 2


def test_stored_governance_joins_and_passes_are_united(spark, data, tmp_path):
    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/c")
    e.run(holdings, items, "2026-07-01", run="a")
    calm = items.where("title NOT LIKE '%resigns%'")
    out = e.run(holdings, calm, "2026-07-01", run="b")
    got = {r.symbol: r for r in out.scores.collect()}
    assert got["AA"].governance_score == 92  # from the event that run a stored
    assert [r.purpose for r in out.evidence.where("event_type = 'management_exit'").collect()] == ["governance"]
    day = lambda n: DAY - timedelta(days=n)
    row = lambda k, t, n: ("CC", k, t, "", f"http://reuters.com/c{k}", "reuters.com", day(n))
    more = {
        "results": spark.createDataFrame([row(9001, "Quiet Corp quarterly results: net profit jumps", 40), row(9002, "Quiet Corp opens a garden", 41)], ITEMS),
        "governance": spark.createDataFrame([row(9003, "Quiet Corp CFO resigns abruptly", 90), row(9004, "Quiet Corp paints a wall", 91)], ITEMS),
        "filings": spark.createDataFrame([row(9005, "Quiet Corp: outcome of board meeting on expansion plan", 12), row(9006, "Quiet Corp: Outcome of Board Meeting on expansion plan", 12)], ITEMS),
        "actions": spark.createDataFrame([row(9007, "Quiet Corp dividend of Rs 5 per share", 20)], ITEMS),
    }
    out = Engine(spark, f"file://{tmp_path}/d").run(holdings, calm, "2026-07-01", run="a", more=more)
    seen = {r.seq: (r.pass_, r.purpose, r.kind) for r in out.evidence.where("symbol = 'CC'").collect()}
    assert seen[9001] == ("results", "sentiment", "news") and seen[9003] == ("governance", "governance", "news") and seen[9007] == ("actions", "sentiment", "action")
    assert 9002 not in seen and 9004 not in seen and len({9005, 9006} & set(seen)) == 1


def test_universe_lock_and_golden_gate(spark, data, tmp_path):
    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="CC added"):
        e.run(holdings, items, "2026-07-01", run="a", locked=holdings.where("symbol <> 'CC'"))
    bad = spark.createDataFrame([("g1", "penalise", -1.0, "regulatory_action", "company", "x fined")], "id string, expected string, expected_weight double, event_type string, subject string, title string")
    with pytest.raises(ValueError, match="g1"):
        e.run(holdings, items, "2026-07-01", run="a", golden=bad)
    assert e.corpus.runs("events") == set()
    e.run(holdings, items, "2026-07-01", run="a", locked=holdings.where("symbol <> 'CC'"), confirmed=True)
    told = {r.symbol: (r.name, r.sector) for r in e.holdings_of(spark.createDataFrame([("AA",), ("ZZ",)], "symbol string")).collect()}
    assert told == {"AA": ("Acme Forge", "Steel"), "ZZ": ("ZZ", "Unclassified")}


def test_backtest_of_all_scores(spark, data, tmp_path):
    holdings, items = data
    e = Engine(spark, f"file://{tmp_path}/c")
    out = e.run(holdings, items, "2026-07-01", run="a")
    last = {r.symbol: r for r in e.backtest("2026-06-24", "2026-07-01").where("as_of = DATE '2026-07-01'").collect()}
    for r in out.scores.where("symbol <> 'CC'").collect():
        got = last[r.symbol]
        assert (got.sentiment_mean, got.governance_score, got.risk_score, got.sector) == (pytest.approx(r.sentiment_mean), r.governance_score, r.risk_score, r.sector)


def test_driver_codes(spark):
    from tidemark.operators import corpus

    s = "symbol string, sentiment_band int, governance_score double, note string, span_days int"
    a = spark.createDataFrame([("A", 1, 100.0, None, 300), ("B", 1, 92.0, None, 300), ("C", 1, 92.0, None, 300), ("D", 1, 100.0, None, 300), ("E", 1, 100.0, None, 300), ("F", 1, 100.0, None, 300)], s)
    b = spark.createDataFrame([("A", 1, 100.0, None, 300), ("B", 1, 100.0, None, 300), ("C", 1, 90.0, None, 300), ("D", 0, 100.0, None, 100), ("E", 0, 100.0, None, 290), ("G", 1, 100.0, None, 300)], s)
    p = "symbol string, event_type string, eff double"
    pa_, pb = spark.createDataFrame([("B", "pledge", -8.0), ("C", "pledge", -8.0)], p), spark.createDataFrame([("C", "pledge", -10.0)], p)
    got = {r.symbol: r.drivers for r in corpus.driver_codes(a, b, pa_, pb).collect()}
    assert got == {"A": "agree", "B": "C", "C": "M", "D": "R", "E": "L", "F": "U", "G": "U"}
    assert {r.drivers for r in corpus.driver_codes(a, b, pa_, pb, linted=True).where("symbol = 'E'").collect()} == {"P"}


def test_command_line(spark, data, tmp_path, capsys):
    from tidemark.cli import main

    holdings, items = data
    holdings.write.parquet(f"file://{tmp_path}/holdings")
    items.write.parquet(f"file://{tmp_path}/items")
    h, i, c = f"file://{tmp_path}/holdings", f"file://{tmp_path}/items", ["--corpus", f"file://{tmp_path}/c"]
    main([*c, "--out", f"file://{tmp_path}/scores", "run", h, i, "2026-07-01", "--run", "a"], spark)
    assert {r.symbol: r.governance_score for r in spark.read.parquet(f"file://{tmp_path}/scores").collect()} == {"AA": 92, "BB": 80, "CC": 100}
    main([*c, "verify", "a", h, "2026-07-01"], spark)
    main([*c, "runs"], spark)
    main([*c, "inspect", "input", h], spark)
    out = capsys.readouterr().out
    assert "2026-07-01" in out and "bolts" in out
    with pytest.raises(SystemExit):
        main([*c, "nothing"], spark)


def test_no_broken_source_goes_unseen(spark, tmp_path):
    from tidemark.sources import connectors as cn

    tried, waits = [], []

    class Fake:
        """Stands for a session whose source fails for some symbols, for some of them once."""

        def __init__(self, bad, once=()):
            self.bad, self.once = set(bad), set(once)

        read = property(lambda self: self)
        format = options = lambda self, *_, **__: self
        option = lambda self, _, symbol: self.__dict__.update(symbol=symbol) or self

        def load(self):
            tried.append(self.symbol)
            if self.symbol in self.bad:
                if self.symbol in self.once:
                    self.bad.discard(self.symbol)
                raise cn.SourceThrottled("down")
            return spark.createDataFrame([(self.symbol,)], "symbol string")

        def __getattr__(self, name):
            return getattr(spark, name)

    rows, errors = cn.fetch_all(Fake("BD", "BD"), "x", list("ABCD"), {}, pause=waits.append)
    assert sorted(r.symbol for r in rows.collect()) == list("ABCD") and errors.count() == 0 and waits == [60.0] and tried == list("ABCDBD")
    with pytest.raises(cn.SourceThrottled, match="three symbols"):
        cn.fetch_all(Fake("BCD"), "x", list("ABCDE"), {}, pause=waits.append)
    with pytest.raises(cn.SourceThrottled, match="no items for B"):
        cn.fetch_all(Fake("B"), "x", list("ABC"), {}, pause=waits.append)
    rows, errors = cn.fetch_all(Fake("BCD"), "x", list("ABCDE"), {}, allow_missing=True, pause=waits.append)
    assert rows.count() == 2 and [r.symbol for r in errors.orderBy("symbol").collect()] == list("BCD")


def test_a_run_loses_nothing(spark, tmp_path):
    """Actions of an exchange are never merged, merged news is recorded and pooled, and a later run restores nothing of it."""
    holdings = spark.createDataFrame([("AM", "Alpha Motors", "Auto", "")], "symbol string, name string, sector string, aliases string")
    row = lambda k, t, n, host: ("AM", k, t, "", f"http://{host}/{k}", host, DAY - timedelta(days=n))
    items = spark.createDataFrame(
        [
            row(1, "Alpha Motors auditor resigns citing delays", 30, "reuters.com"),
            row(2, "Statutory auditor resignation rocks Alpha Motors board", 28, "livemint.com"),
            row(3, "Alpha Motors: customs demand upheld", 60, "reuters.com"),
            row(4, "Market closes higher", 3, "x.com"),
            row(5, "Auditor resigns at Alpha Motors citing long delays", 30, "other.com"),
            row(8, "Alpha Motors auditor resigns citing delays", 30, "copy.com"),
        ],
        ITEMS,
    )
    more = {"actions": spark.createDataFrame([row(6, "Alpha Motors dividend of Rs 5 per share", 30, "exchange.com"), row(7, "Alpha Motors interim dividend Rs 9 per share", 28, "exchange.com")], ITEMS)}
    told = lambda rows: rows.withColumn(
        "label",
        F.struct(
            F.when(F.contains(F.lower("title"), F.lit("auditor")), "auditor_resignation").when(F.contains("title", F.lit("dividend")), "dividend").otherwise("litigation").alias("event_type"),
            F.lit(-1).alias("sentiment"), F.lit(False).alias("governance_flag"), F.lit("low").alias("materiality"),
        ),
    ).withColumn("rationale", F.lit("said so"))
    e = Engine(spark, f"file://{tmp_path}/c")
    out = e.run(holdings, items, "2026-07-01", told, run="a", more=more)
    evidence = {r.seq: r for r in out.evidence.collect()}
    merged = {r.seq: (r.into, r.step) for r in out.merged.collect()}
    dropped = {r.seq for r in out.dropped.collect()}
    assert {6, 7} <= set(evidence) and {4, 8} == dropped
    assert sorted([*evidence, *merged, *dropped]) == [1, 2, 3, 4, 5, 6, 7, 8]
    one = next(r for r in evidence.values() if r.event_type == "auditor_resignation")
    assert one.n_sources == 3 and set(one.sources) == {"reuters.com", "livemint.com", "other.com"} and len(one.url_hashes) == 3 and one.n_members == 3
    assert one.event_date == DAY - timedelta(days=30) and {s for _, s in merged.values()} == {"before labelling", "after labelling"}
    assert e.corpus.read("articles").count() == 8


def test_merged_reports_do_not_come_back(spark, tmp_path):
    holdings = spark.createDataFrame([("AM", "Alpha Motors", "Auto", "")], "symbol string, name string, sector string, aliases string")
    row = lambda k, t, n, host: ("AM", k, t, "", f"http://{host}/{k}", host, DAY - timedelta(days=n))
    items = spark.createDataFrame([row(1, "Alpha Motors CFO resigns abruptly over dispute", 30, "reuters.com"), row(2, "Finance chief of Alpha Motors: CFO quits amid row", 28, "livemint.com")], ITEMS)
    e = Engine(spark, f"file://{tmp_path}/c")
    first = e.run(holdings, items, "2026-07-01", run="a")
    assert [r.n_sources for r in first.evidence.where("governance_flag").collect()] == [2]
    again = e.run(holdings, items.where("seq = 2"), "2026-07-01", run="b")
    assert again.evidence.where("governance_flag").count() == 1
    assert [r.governance_score for r in first.scores.collect()] == [r.governance_score for r in again.scores.collect()]


def test_company_words_tell_no_events_apart(spark):
    from tidemark.operators import governance

    rows = [("AM", 1, "Alpha Motors: customs demand upheld", DAY, -20.0, "regulatory_action", None, "Alpha Motors"), ("AM", 2, "Alpha Motors barred from tender over pollution", DAY - timedelta(days=2), -20.0, "regulatory_action", None, "Alpha Motors")]
    df = spark.createDataFrame(rows, "symbol string, seq long, title string, published date, penalty double, event_type string, event_key string, company string")
    assert governance.same_events(df).count() == 0 and governance.same_events(df.drop("company")).count() == 1


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    from tidemark.operators.corpus import Corpus

    c = Corpus(spark, f"file://{tmp_path}/c")
    good = spark.createDataFrame([("x", 1)], "symbol string, n int")
    c.publish({"events": good, "scores": good}, "a")
    bad = good.select("symbol", F.raise_error(F.lit("lost")).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        c.publish({"events": good, "scores": bad}, "b")
    assert c.unfinished() == {"b"} and c.runs("events") == {"a"} and {r.run_id for r in c.read("events").collect()} == {"a"}
    with pytest.raises(ValueError, match="already"):
        c.publish({"events": good}, "a")
    c.publish({"events": good, "scores": good}, "b")
    assert c.unfinished() == set() and c.runs("scores") == {"a", "b"} and c.read("events").count() == 2
