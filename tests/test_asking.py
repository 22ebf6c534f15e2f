"""Batches that fail, throttling, and replies in every shape."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import asking

LABEL = "struct<event_type:string,sentiment:int>"


def reply(batch):
    return json.dumps([{"id": str(x["seq"]), "event_type": "other", "sentiment": 1, "rationale": "said"} for x in batch])


def told(rows, ask, size=8, waits=(), slept=None, state=None):
    return list(asking.ask_all(rows, "seq", ask, size, waits, (slept if slept is not None else []).append, {} if state is None else state))


def numbers(n):
    return [{"seq": k} for k in range(n)]


def test_one_bad_item_loses_itself_alone():
    asks = []

    def ask(batch):
        asks.append([x["seq"] for x in batch])
        if any(x["seq"] == 5 for x in batch):
            raise ValueError("not this one")
        return reply(batch)

    out = {r["seq"]: (x is not None, e) for r, x, e in told(numbers(16), ask)}
    assert out == {k: (k != 5, "ValueError: not this one" if k == 5 else None) for k in range(16)}
    assert asks == [list(range(8)), [0, 1, 2, 3], [4, 5, 6, 7], [4, 5], [4], [5], [6, 7], list(range(8, 16))]


def test_a_reply_that_leaves_items_out_is_asked_again_for_those():
    asks = []

    def ask(batch):
        asks.append(len(batch))
        return "Sure! " + reply(batch[:3])

    assert all(e is None for _, _, e in told(numbers(8), ask)) and asks == [8, 5, 2]


def test_throttled_calls_wait_and_at_last_stop():
    slept, state, asks = [], {}, []

    def ask(batch):
        asks.append(len(batch))
        if len(asks) in (2, 3) or len(asks) > 4:
            raise RuntimeError("HTTP 429")
        return reply(batch)

    out = told(numbers(24), ask, 4, (1, 2, 3), slept, state)
    assert [r["seq"] for r, x, _ in out if x] == list(range(8))
    assert {e for _, x, e in out if not x} == {asking.ABORTED} and sorted(r["seq"] for r, _, _ in out) == list(range(24))
    assert slept == [1, 2, 1, 2, 3] and state == {"aborted": True}


@pytest.mark.parametrize(
    "text, ids",
    [
        ('[{"id": "a"}, {"id": "b"}]', ["a", "b"]),
        ('Here:\n```json\n[{"id": "a", "x": {"y": "}"}}]\n```\nbye {', ["a"]),
        ('{"labels": [{"id": "a"}, 3, {"no": 1}]}', ["a"]),
        ('{"id": 7, "subject": {"id": "inner"}}', ["7"]),
        ('[{"id": "a"}, {"id": "b", "x": [1, {"id": "c"', ["a"]),
        ('[{"id": "a"}, {"id": "b, \n{"id": "c"}]', ["a", "c"]),
        ('see [1] and "this [{"id": "a", "t": "he said \\"{\\""}]', ["a"]),
        ("}}]] no {labels} here", []),
        ("", []),
        (None, []),
    ],
)
def test_shapes_of_replies(text, ids):
    assert [str(x["id"]) for x in asking.answers(text)] == ids


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text('ab{}[]"\\,:\n', max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k{}[]"\\', max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.text("xyz{}\"", min_size=1, max_size=3), values, max_size=4), min_size=1, max_size=5), st.sampled_from(["", "Sure, see [below]:\n", "```json\n"]), st.integers(0, 10**6))
def test_whole_objects_come_out_wherever_the_reply_breaks_off(objects, before, cut):
    objects = [{**o, "id": str(k)} for k, o in enumerate(objects)]
    parts = [json.dumps(o) for o in objects]
    text = before + "[" + ", ".join(parts) + "]\n```"
    assert list(asking.answers(text)) == objects
    at, ends = len(before) + 1, []
    for p in parts:
        ends.append(at + len(p))
        at += len(p) + 2
    cut = cut % (len(text) + 1)
    got = list(asking.answers(text[:cut]))
    whole = [o for o, e in zip(objects, ends) if e <= cut]
    assert got[: len(whole)] == whole


def test_long_broken_replies_take_one_pass():
    began = time.time()
    assert list(asking.answers("[{" * 100_000)) == [] and list(asking.answers("}]" * 100_000)) == []
    assert len(list(asking.answers("[" * 50_000 + '{"id": "a"}'))) == 1
    assert time.time() - began < 5


def test_over_spark(spark):
    rows = spark.createDataFrame([(k, f"title {k}", None) for k in range(50)], "seq long, title string, snippet string")
    got = asking.asked(rows, lambda b: reply([x for x in b if x["seq"] % 10]), LABEL, tasks=3).collect()
    assert len(got) == 50 and all((r.label is None) == (r.seq % 10 == 0) == (r.label_error == asking.NO_LABEL) for r in got)
    assert asking.asked(rows.limit(0), reply, LABEL).count() == 0
    replies = spark.createDataFrame([(1, reply(numbers(3))), (2, None), (3, "no")], "k int, reply string")
    assert sorted((r.k, r.id, json.loads(r.label)["sentiment"]) for r in asking.read_replies(replies).collect()) == [(1, "0", 1), (1, "1", 1), (1, "2", 1)]


def test_a_run_that_is_throttled_keeps_its_labels(spark, tmp_path):
    holdings = spark.createDataFrame([("AA", "Acme Forge", "Steel", "")], "symbol string, name string, sector string, aliases string")
    names = ["copper", "harbour", "tunnel", "bridge", "turbine", "cement", "lorry", "reactor", "airport", "satellite"]
    items = [("AA", k, f"Acme Forge wins {w} contract number {k}{k}{k}{k}", w, f"https://reuters.com/{k}", "reuters", f"2026-0{1 + k % 6}-1{k % 9}") for k, w in enumerate(names)]
    items = spark.createDataFrame(items, "symbol string, seq long, title string, snippet string, url string, source string, published string").withColumn("published", F.col("published").cast("date"))
    e = Engine(spark, f"file://{tmp_path}/c")
    log = tmp_path / "asked"
    log.mkdir()

    def ask(batch, broken):
        for x in batch:
            (log / f"{broken}_{x['seq']}").touch()
        if broken and any(x["seq"] >= 6 for x in batch):
            raise RuntimeError("quota is used up")
        return json.dumps([{"id": str(x["seq"]), "event_type": "order_win", "sentiment": 1, "rationale": "a contract", "governance_flag": False} for x in batch])

    kind = "struct<event_type:string,sentiment:int,governance_flag:boolean>"
    by = lambda broken: lambda rows: asking.asked(rows.orderBy("seq"), lambda b: ask(b, broken), kind, size=1, tasks=1, waits=())
    with pytest.raises(asking.LabellingAborted):
        e.run(holdings, items, "2026-07-01", by(True), run="r1", model="m")
    kept = e.corpus.read("labels").count()
    assert kept < 10 and e.corpus.runs("events") == set()
    out = e.run(holdings, items, "2026-07-01", by(False), run="r1", model="m")
    assert out.evidence.count() + out.merged.count() == 10 and len(list(log.glob("False_*"))) == 10 - kept
