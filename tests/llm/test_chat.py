import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    made = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(3))
    return {r.conv_id: r for r in chat.read_chats(made).collect()}, {r.conv_id: r for r in made.collect()}


def expected(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def agree(spark, rows):
    got, made = back(spark, rows)
    want = expected(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted_chars == len(made[c].formatted)
        spans = [(s.start, s.start + s.length) for s in made[c].loss]
        assert all(b <= a for (_, b), (a, _) in zip(spans, spans[1:]))
        assert len(spans) == sum(r == "assistant" for r, _ in turns)


def test_odd_rows(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [
        (1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (1, 3, "assistant", "a<+>b"), (1, 4, None, "x"), (1, 5, "a: b\n### c", "</turn>\n### user: y"),
        (2, 0, "system", ""), (3, None, "user", "null turn"), (3, 1, "user", "one"), (3, 1, "user", "one"), (None, 0, "user", "no id"), (4, 0, "assistant", "😀é\\s\\t" * 3000), (5, 0, "user", "<"), (5, 1, "user", "/turn>\n"),
    ]
    agree(spark, rows)


def test_empty_table_and_clashing_names(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a")], TURNS).selectExpr("*", "1 AS t", "2 AS p", "3 AS formatted", "4 AS loss")
    assert chat.read_chats(chat.format_chats(df)).first().turns[0].text == "a"


def test_a_very_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"{'é' * (k % 11)}turn {k}") for k in range(60_000)]
    rows += [(2, k, "assistant", "") for k in range(450)] + [(3, 0, "assistant", "😀 long " * 40_000)]
    agree(spark, rows)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5), st.sampled_from(["user", "assistant", "a:b", "#"]), st.text(st.sampled_from("\\#<+>/turnsthpc: \n"), max_size=25)), min_size=1, max_size=25))
@settings(max_examples=12, deadline=None)
def test_any_turns(spark, rows):
    agree(spark, rows)


def test_query(spark):
    out = {r.conv_id: r for r in chat.op10_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = r"\### Assistant: </turn> ok"
    assert out[-7].n_turns == 2 and out[-7].loss_chars == len(said)
    assert out[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
