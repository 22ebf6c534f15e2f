"""Sampling, clustering, labels and sources."""

import json
import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import cluster, corpus, label, market, sample
from tidemark.sources import connectors, files, fulltext
from tidemark.streaming import labels

DAY = date(2026, 7, 1)


def as_of():
    return F.lit("2026-07-01").cast("date")


ITEMS = "symbol string, seq long, title string, url string, published date, relevance int, usable boolean"


def items(spark, ages, titles=None):
    return spark.createDataFrame([("AA", k, titles[k] if titles else f"headline number {k}", f"http://x/{k}", DAY - timedelta(days=a), 0, True) for k, a in enumerate(ages)], ITEMS)


def windows(df):
    return [df.where(f"status = 'selected' and win = {k}").count() for k in range(1, 5)]


def test_sampler_quotas(spark):
    ages = [k % 366 for k in range(400)]
    assert windows(sample.stratified(items(spark, ages), as_of())) == [40, 25, 20, 15]


def test_sampler_carries_and_rolls_back(spark):
    assert windows(sample.stratified(items(spark, range(120)), as_of())) == [31, 49, 20, 0]


def test_sampler_day_cap(spark):
    out = sample.stratified(items(spark, [3] * 20), as_of())
    assert out.where("status = 'selected'").count() == 6 and out.where("status = 'extra'").count() == 14


def loop(rows, quotas, cap):
    """The sampler as a loop: pools by window, newest first; a shared day counter; two passes."""
    pools = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0])) for k in range(1, 5)}
    day, picked, extra = {}, set(), set()

    def take(k, want):
        got = 0
        for seq, age, _ in pools[k]:
            if got >= want:
                break
            if seq in picked or seq in extra:
                continue
            if day.get(age, 0) >= cap:
                extra.add(seq)
                continue
            day[age] = day.get(age, 0) + 1
            picked.add(seq)
            got += 1
        return got

    carry = 0
    for k in pools:
        carry = quotas[k - 1] + carry - take(k, quotas[k - 1] + carry)
    for k in pools:
        if carry > 0:
            carry -= take(k, carry)
    return picked, extra


@pytest.mark.parametrize("seed", range(4))
def test_sampler_equals_loop(spark, seed):
    rng = random.Random(seed)
    ages = [rng.choice([rng.randrange(10), rng.randrange(366), rng.randrange(150, 170)]) for _ in range(rng.randrange(60, 260))]
    win = lambda a: 1 if a <= 30 else 2 if a <= 90 else 3 if a <= 180 else 4
    picked, extra = loop([(k, a, win(a)) for k, a in enumerate(ages)], [40, 25, 20, 15], 6)
    out = sample.stratified(items(spark, ages), as_of()).collect()
    assert {r.seq for r in out if r.status == "selected"} == picked
    assert {r.seq for r in out if r.status == "extra"} == extra


def test_governance_quotas_keep_the_old_order(spark):
    out = sample.governance_candidates(items(spark, [*[k % 30 for k in range(40)], 300]), as_of()).collect()
    assert len(out) == 30 and any(r.win == 4 for r in out)


def test_scaled_quotas():
    assert sample.scaled_quotas(200) == [80, 50, 40, 30]
    assert sample.scaled_quotas(150) == [60, 38, 30, 22]


def test_confidence(spark):
    row = spark.range(1).select(*[F.bround(tx.confidence(F.lit(n), F.lit(t)), 3).alias(f"c{k}") for k, (n, t) in enumerate([(1, "T1"), (11, "T1"), (1, "T4")])]).first()
    assert tuple(row) == (0.504, 0.773, 0.252)


def test_one_event_from_a_flood(spark):
    titles = [f"Acme wins solar tender worth 500 from northern grid outlet{k % 3}" for k in range(40)] + ["Quite another matter entirely"]
    df = items(spark, [k % 3 for k in range(41)], titles)
    out = {r.seq: r.cluster for r in cluster.clusters(df).collect()}
    assert {out[k] for k in range(40)} == {0} and out[40] == 40


def test_merge_equals_loop(spark):
    rng = random.Random(9)
    rows = [("AA", rng.choice(["earnings_beat", "litigation"]), True, k, f"t{rng.randrange(5)}", DAY - timedelta(days=rng.randrange(200)), None, rng.choice(["T1", "T2", "T3"]), rng.choice(["sentiment", "governance"]), f"http://x{k % 7}.com/{k}") for k in range(80)]
    df = spark.createDataFrame(rows, "symbol string, event_type string, governance_flag boolean, seq long, title string, published date, event_date date, max_tier string, purpose string, url string")
    got = {r.seq: (r.survivor, r.event_date, r.n_merged, r.purpose, r.max_tier, tuple(r.sources), r.n_sources, r.n_members, len(r.url_hashes)) for r in cluster.merge_labelled(df).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (r[5], r[4], r[3])):
        n = {"et": r[1], "rep": r[3], "pub": r[5], "date": r[5], "tier": r[7], "purpose": r[8], "all": [r[3]], "src": {r[9].split("/")[2]}}
        for k, o in enumerate(kept):
            if o["et"] != n["et"]:
                continue
            q = lambda d: (d.year, (d.month - 1) // 3)
            if abs((o["date"] - n["date"]).days) <= 3 or (n["et"] == "earnings_beat" and q(o["pub"]) == q(n["pub"]) and o["purpose"] == n["purpose"]):
                a, b = (o, n) if (o["tier"], o["pub"]) <= (n["tier"], n["pub"]) else (n, o)
                kept[k] = {**a, "date": min(o["date"], n["date"]), "tier": min(o["tier"], n["tier"]), "all": o["all"] + n["all"], "src": o["src"] | n["src"], "purpose": "sentiment" if b["purpose"] == "sentiment" else a["purpose"]}
                break
        else:
            kept.append(n)
    assert got == {s: (o["rep"], o["date"], len(o["all"]), o["purpose"], o["tier"], tuple(sorted(o["src"])), len(o["src"]), len(o["all"]), len(o["all"])) for o in kept for s in o["all"]}


def test_labels_and_reasons(spark):
    rows = [(0, "Acme CFO resigns amid probe", "http://x", DAY), (1, "Acme CEO quits", "http://x", DAY), (2, "Acme profit jumps", "", DAY), (3, "Acme wins order", "http://x", DAY + timedelta(days=1)), (4, "Nobody named", "http://x", DAY)]
    df = spark.createDataFrame(rows, "seq long, title string, url string, published date")
    x = df.withColumn("x", label.keyword_label(F.col("title"), F.lit(""), F.lit("Acme Ltd"))).select("*", "x.*").withColumn("labelled", F.lit(True)).withColumn("rationale", F.lit("r"))
    out = {r.seq: r for r in label.validated(x, as_of(), 365).collect()}
    assert [out[k].event_type for k in range(5)] == ["investigation", "management_exit", "earnings_beat", "order_win", "other"]
    assert [out[k].reason for k in range(5)] == [None, None, "missing_source_url", "date_in_future", "not_about_company"]


def test_price_sentences(spark):
    t = "Profit rose. The share price hit a high. Shares fell [context]. Orders grew."
    row = spark.range(1).select(tx.strip_price_sentences(F.lit(t)).alias("a"), tx.cap_words(F.lit("One two. Three four five. Six."), 5).alias("b")).first()
    assert row.a == "Profit rose. Shares fell . Orders grew." and row.b == "One two. Three four five."


def test_market(spark):
    rows = [("A", date(2026, 1, 1) + timedelta(days=k), 100.0 + k) for k in range(0, 200, 5)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    r = market.returns(df, "2026-07-10").first()
    assert r.ret_1m == pytest.approx(290 / 260 - 1 if r.last_date == date(2026, 7, 10) else r.ret_1m)
    assert market.volatility(df.limit(2)).first().realised_vol is None


def test_corpus_is_append_only_and_replays(spark, tmp_path):
    c = corpus.Corpus(spark, f"file://{tmp_path}/c")
    ev = spark.createDataFrame([(1, "AA", DAY, 1), (2, "AA", DAY + timedelta(days=3), -1)], "event_id long, symbol string, event_date date, sentiment int")
    c.append("events", ev, "2026-07-01_a")
    c.append("events", ev.withColumn("sentiment", F.lit(2)), "2026-07-09_b")
    with pytest.raises(ValueError, match="already"):
        c.append("events", ev, "2026-07-01_a")
    man = spark.createDataFrame([("2026-07-01_a", DAY, "live"), ("2026-07-09_b", DAY + timedelta(days=8), "live")], "run_id string, as_of date, mode string")
    total = lambda rows, day: rows.agg(F.sum("sentiment").alias("s"), F.count("*").alias("n"))
    assert tuple(corpus.replay(c.read("events"), man, "2026-07-01", total).first()) == (1, 1)
    assert tuple(corpus.replay(c.read("events"), man, "2026-07-04", total).first()) == (4, 2)
    assert c.read("events", ["2026-07-01_a"]).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿Symbol,Name,Sector,Weight\nAA,Acme,Steel,2%\n,x,y,\nBB,Bolt,,\n", encoding="utf-8")
    p = files.portfolio(spark, str(tmp_path / "p.csv"))
    assert sorted(r.symbol for r in p.collect()) == ["AA", "BB"]
    (tmp_path / "bad.csv").write_text("Symbol,Name\nAA,Acme\n")
    with pytest.raises(ValueError, match="sector"):
        files.portfolio(spark, str(tmp_path / "bad.csv"))
    uni = spark.createDataFrame([("BB", "Bolt Works", "Tools", "bolts|the bolt people")], "symbol string, name string, sector string, aliases string")
    assert {r.symbol: r.sector for r in files.enriched(p, uni).collect()} == {"AA": "Steel", "BB": "Tools"}
    assert [r.symbol for r in files.find_holdings("the bolt people", uni).collect()] == ["BB"]
    (tmp_path / "n.json").write_text(json.dumps({"AA": [{"title": "t", "url": "", "date": "2026-06-30"}, {"title": "u", "date": "bad"}]}))
    got = files.items(spark, str(tmp_path / "n.json")).orderBy("pos").collect()
    assert [(r.title, r.published) for r in got] == [("t", date(2026, 6, 30)), ("u", None)]
    (tmp_path / "t.txt").write_text("Symbol\tName\nNSE: AA\tAcme Limited\tINE123456789\nAA\tAgain\nBB  Bolt Works Ltd\n")
    got = {r.symbol: (r.name, r.isin) for r in files.pasted(spark, str(tmp_path / "t.txt")).collect()}
    assert got["AA"] == ("Acme", "INE123456789") and got["BB"] == ("Bolt Works", None)


def no_network(url):
    if "market" in url:
        return json.dumps({"closes": {"2026-06-01": 100, "2026-06-10": 50}, "dividends": {"2026-06-05": 2.0, "2026-06-20": 2.0}, "splits": {"2026-06-21": 2}})
    if "page" in url:
        if "bad" in url:
            raise OSError("gone")
        return f"<p>{'long text here ' * 20}</p>"
    if "feed" in url:
        return "<rss><channel>" + "".join(f"<item><title>Acme news {k} - Mint</title><link>http://m/{k}</link><pubDate>Tue, 30 Jun 2026 10:00:00 GMT</pubDate><source url='https://www.mint.com'>Mint</source></item>" for k in range(3)) + "</channel></rss>"
    if "filings" in url:
        return json.dumps({"Table": [{"SLONGNAME": "Acme Ltd", "NEWSSUB": t, "NEWS_DT": "2026-06-30T00:00", "NSURL": "http://b"} for t in ("CFO resigns", "Financial results", "Newspaper copy")] + [{"SLONGNAME": "Other", "NEWSSUB": "x", "NEWS_DT": "2026-06-30"}]})
    lo = url.split("startdatetime=")[1][:8]
    return json.dumps({"articles": [{"title": f"t{k}", "url": f"http://g/{lo}{k}", "seendate": lo + "T000000Z", "domain": "g.com"} for k in range(20)]})


def test_connectors(spark):
    connectors.register(spark)
    opts = {"opener": "test_items.no_network", "symbols": "AA=Acme", "start": "2026-01-01", "end": "2026-07-01", "wait": "0"}
    read = lambda name, **more: spark.read.format(name).options(**opts, **more).load()
    assert read("news_archive", days="30").count() == 20 * 7
    assert read("news_archive", days="30", limit="50").count() == 60
    feed = read("news_feed").collect()
    assert feed and all(r.title.startswith("Acme news") and not r.title.endswith("Mint") and r.source == "mint.com" for r in feed)
    passes = {r["pass"] for r in read("exchange_announcements").collect()}
    assert passes == {"governance", "results", "sentiment"}


def test_market_data_and_pages(spark):
    connectors.register(spark)
    rows = spark.read.format("market_data").options(opener="test_items.no_network", symbols="AA|BB", start="2026-01-01", end="2026-07-01").load()
    got = {(r.event_type, r.published.day): r.materiality for r in rows.where("symbol = 'AA' and kind = 'action'").collect()}
    assert got == {("dividend", 5): "medium", ("dividend", 20): "high", ("split_bonus", 21): "medium"}
    assert rows.where("kind = 'price'").count() == 4
    pages = fulltext.fetched(spark.createDataFrame([(1, "page:1"), (2, "page:bad"), (3, None)], "seq int, url string"), "test_items.no_network")
    text = {r.seq: r.t for r in pages.select("seq", fulltext.extract(F.col("html")).alias("t")).collect()}
    assert text[1].startswith("long text") and text[2] == "" and text[3] == ""


def noted(url):
    """An opener that leaves the time of each call in the folder that the url begins with."""
    import time
    import uuid

    (Path(url.split("?")[0]) / f"{time.time():.3f}_{uuid.uuid4().hex}").touch()
    return json.dumps({"articles": [{"title": "t", "url": "http://g/" + url.split("startdatetime=")[1][:8], "seendate": url.split("startdatetime=")[1][:8] + "T000000Z", "domain": "g.com"}]})


def test_requests_are_spaced(spark, tmp_path):
    now, told = [100.0], []
    paced = connectors.Paced(lambda u: told.append((u, now[0])) or now.__setitem__(0, now[0] + float(u)), 5, 2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for took in ("0", "1", "9", "0"):
        paced(took)
    assert told == [("0", 102.0), ("1", 107.0), ("9", 112.0), ("0", 121.0)]
    connectors.register(spark)
    for lanes in ("1", "2"):
        place = tmp_path / lanes
        place.mkdir()
        opts = {"opener": "test_items.noted", "symbols": "AA=Acme|BB=Best", "start": "2026-01-01", "end": "2026-03-01", "days": "20", "base": str(place), "pace": "0.3", "lanes": lanes}
        rows = spark.read.format("news_archive").options(**opts).load()
        assert rows.rdd.getNumPartitions() == int(lanes) and rows.count() == 6
        at = sorted(float(p.name.split("_")[0]) for p in place.iterdir())
        assert len(at) == 6
        if lanes == "1":
            assert min(b - a for a, b in zip(at, at[1:])) > 0.29
        else:
            assert min(b - a for a, b in zip(at, at[2:])) > 0.29  # lanes start when their tasks do, so pairs may be close


def test_throttle_pages_raise():
    waits = []
    with pytest.raises(connectors.SourceThrottled):
        connectors.fetched(lambda u: "Please limit requests", "u", connectors.parse_archive, 3, 20, waits.append)
    assert waits == [20, 20]
    with pytest.raises(connectors.SourceThrottled):
        connectors.fetched(lambda u: "<html>blocked</html>", "u", connectors.parse_feed, 2, 1, waits.append)
    assert connectors.without_publisher("A - B - Mint", "Mint") == "A - B"
    assert connectors.without_publisher("Plain headline", "Mint") == "Plain headline"


def test_source_policy():
    d = date(2026, 7, 10)
    assert connectors.resolve_source("auto", date(2026, 7, 1), d, 3) == ("archive", "archive")
    assert connectors.resolve_source("auto", d, d, 3) == ("feed", "live")
    with pytest.raises(ValueError, match="past"):
        connectors.resolve_source("feed", date(2026, 7, 1), d, 3)


def test_fulltext(spark):
    body = "word " * 60
    pages = [f'<script type="application/ld+json">{{"articleBody": "{body}"}}</script>', f"<p>{'long text here ' * 20}</p><p>cookie {'x' * 80}</p>", "<p>short</p>"]
    got = [r.t for r in spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, h string").orderBy("k").select(fulltext.extract(F.col("h")).alias("t")).collect()]
    assert got == [body.strip(), ("long text here " * 20).strip(), ""]


def test_stream_labels_once(spark, tmp_path):
    src, out, chk = (f"file://{tmp_path}/{x}" for x in ("src", "out", "chk"))
    rows = spark.createDataFrame([(f"k{k}", "AA", "Acme", "Acme wins order", "", None) for k in range(5)], labels.ITEMS)
    rows.write.parquet(src)
    labels.run_once(spark, src, out, chk)
    rows.limit(3).write.mode("append").parquet(src)
    labels.run_once(spark, src, out, chk)
    assert spark.read.parquet(out).count() == 5


def test_stream_state_and_late_items(spark, tmp_path):
    """Repeats within a batch and across runs, late items apart, state that goes, and a batch that is run again."""
    from datetime import datetime

    src, out, late, chk = (f"file://{tmp_path}/{x}" for x in ("src", "out", "late", "chk"))
    row = lambda key, month, day: (key, "AA", "Acme", f"Acme wins order {key}", "", datetime(2024, month, day, 1, 30, 0, 123456))

    def come(*rows):
        spark.createDataFrame(list(rows), labels.ITEMS).coalesce(1).write.mode("append").parquet(src)
        return labels.run_once(spark, src, out, chk, late, keep_ms=1)

    read = lambda path: sorted((r.item_key, r.published) for r in spark.read.parquet(path).collect())
    come(row("a", 1, 1), row("a", 1, 1), row("b", 1, 2), row(None, 1, 3), row(None, 1, 3))
    come(row("c", 2, 20), row("a", 1, 1), row("d", 1, 1))
    assert [k for k, _ in read(out) if len(k) == 1] == ["a", "b", "c", "d"] and len(read(out)) == 5
    # the newest item is of 20 February, so what is older than the 13th is late now, seen before or not
    progress = come(row("c", 2, 20), row("e", 1, 5), row("e", 1, 5), row("f", 2, 14))
    assert [k for k, _ in read(out) if len(k) == 1] == ["a", "b", "c", "d", "f"]
    assert read(late) == [("e", row("e", 1, 5)[5])] * 2
    assert progress["stateOperators"][0]["numRowsTotal"] == 2  # c and f, all of January has gone
    come(row("a", 1, 1))
    assert [k for k, _ in read(late)] == ["a", "e", "e"] and dict(read(out))["c"] == row("c", 2, 20)[5]
    # without the marker of its end the last batch is run again and takes its own place
    done = max((p for p in (tmp_path / "chk" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    kept = read(out), read(late)
    for p in (done, done.with_name(f".{done.name}.crc")):
        p.unlink(missing_ok=True)
    assert labels.run_once(spark, src, out, chk, late, keep_ms=1) is not None and (read(out), read(late)) == kept


BODY = "The works won the order after a long tender. " * 6
PAGES = [
    f'<html><script type="application/ld+json">{{"@type": "NewsArticle", "articleBody": "{BODY}line\\nbreak &amp;amp; \\u20b9 5 &#8377;"}}</script><p>short</p></html>',
    f'<script type="application/ld+json">not json</script><script data-x type="application/ld+json">\n{{"@graph": [{{"name": "x"}}, {{"articleBody": "{BODY}in a graph"}}]}}\n</script>',
    f'<script type="application/ld+json">[{{"articleBody": "too short"}}, {{"articleBody": "{BODY}in a list"}}]</script>',
    '<meta name="description" content="A description that is quite long &ndash; longer than eighty characters, so it leads the text of the page."><nav><p>'
    + "menu words " * 20 + "</p></nav><p>" + "First paragraph of the story with enough words to be kept by the rule. " * 3 + "</p><p>Subscribe to our newsletter for more stories like this one and many others every day</p><p>"
    + "Second &eacute;t&eacute;&nbsp;paragraph &#x2014; &#150; &unknown; of the story, also long enough. " * 3 + "</p>",
    '<meta content="Another description, this time with its content before its name, and long enough to stand alone." property="og:description"><p>tiny</p>',
    "<p>tiny</p>", "", None,
]


def test_text_of_pages_against_a_loop(spark):
    """What a page parser by the language's own tools makes of the pages."""
    import html as h
    import json as j
    import re

    from tidemark.sources import fulltext as ft

    clean = lambda s: " ".join(h.unescape(re.sub("<[^>]+>", " ", s)).split())

    def expected(raw):
        raw = raw or ""
        for m in re.findall(ft.SCRIPT, raw):
            try:
                x = j.loads(m)
            except ValueError:
                continue
            for o in x if isinstance(x, list) else x.get("@graph", [x]):
                if len(o.get("articleBody", "")) > 200:
                    return clean(o["articleBody"])[:4000]
        m = re.search(ft.ABOUT[0], raw) or re.search(ft.ABOUT[1], raw)
        about = clean(m[1]) if m else ""
        bare = re.sub(rf"(?is)<({'|'.join(ft.ASIDE)})[^>]*>.*?</\1>", " ", raw)
        kept = [p for p in map(clean, re.findall("(?is)<p[^>]*>(.*?)</p>", bare)) if len(p) > 70 and not re.search(ft.JUNK, p) and p != about]
        if sum(map(len, kept)) > 250:
            return (about + " " if len(about) > 80 else "") + " ".join(kept)[:4000]
        return about if len(about) > 80 else ""

    df = spark.createDataFrame(list(enumerate(PAGES)), "k int, html string")
    got = {r.k: r.text for r in df.select("k", ft.extract(F.col("html")).alias("text")).collect()}
    assert got == {k: expected(x) for k, x in enumerate(PAGES)}
    assert "₹ 5 ₹" in got[0] and got[1].endswith("in a graph") and got[2].endswith("in a list") and "été paragraph — – &unknown;" in got[3] and got[4] and not got[5]


def test_commentary_and_replies(spark):
    rows = spark.range(1).select(
        tx.scrubbed(F.lit("Strong year — two-wheeler sales rose - again. The merger is quarantined. Calm.\n\nGate B holds it.\n\nEnd–note.")).alias("a"),
        tx.scrubbed(F.lit("One two three. Four five. Six."), 4).alias("b"),
        tx.cap_words(F.lit("One two three four. Five."), 2).alias("c"),
        tx.reply_objects(F.lit('Sure [1]:\n```json\n{"labels": [{"id": 1, "x": "a"}, {"id": 2}, {"x": 3}, {"id": 4, bad}, {"id": 5')).alias("d"),
        tx.reply_objects(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert rows.a == "Strong year, two-wheeler sales rose, again. Calm.\n\nEnd, note."
    assert rows.b == "One two three." and rows.c == "One two three four." and rows.d == ['{"id": 1, "x": "a"}', '{"id": 2}'] and rows.e == []
