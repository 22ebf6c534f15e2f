"""Labels from a model that takes items in batches and answers in text.

A task asks for its rows batch by batch. A batch of which nothing comes back is halved until the item that spoils it is
alone, a reply that leaves items out is asked again for those, and a throttled call waits. Only rows without a label have
an error. Where throttling goes on the task asks no more, and its other rows say so, so that what came can be kept.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Words of an error that tells of throttling (fixed values).
THROTTLED = ("rate", "limit", "overload", "429", "529", "quota", "too many", "capacity", "usage")
#: Seconds to wait before a throttled call is made again (fixed values).
WAITS = (30.0, 60.0, 120.0)
ABORTED = "aborted: the model kept throttling"
NO_LABEL = "no label in the reply"

MARK = re.compile(r'\\.|["{}\[\]\n]', re.S)


class LabellingAborted(RuntimeError):
    """The model kept throttling; the labels that came are stored, so a new run asks for the rest only."""


def spans(text: str) -> list[tuple[int, int]]:
    """Where braces open and close in pairs, in the order in which they open.

    Braces and brackets inside strings don't count, and a string ends with its line, as none of JSON's goes on. What a
    closing one leaves open inside it is stray. One pass, however deep the text nests."""
    stack: list[tuple[str, int]] = []
    opens = {"{": 0, "[": 0}
    found, quoted = [], False
    for m in MARK.finditer(text):
        c = m.group()
        if c == '"':
            quoted = bool(stack) and not quoted
        elif c == "\n":
            quoted = False
        elif quoted or c[0] == "\\":
            continue
        elif c in opens:
            stack.append((c, m.start()))
            opens[c] += 1
        else:
            mate = "{" if c == "}" else "["
            if opens[mate]:
                while True:
                    kind, at = stack.pop()
                    opens[kind] -= 1
                    if kind == mate:
                        break
                if mate == "{":
                    found.append((at, m.end()))
    return sorted(found)


def answers(text: str | None) -> Iterator[dict]:
    """The objects with an id in a reply: an array of them, one alone, or those in a list of an object around them, with
    prose and code fences about. Of an array that breaks off, the objects that are whole. Objects within one count as
    parts of it."""
    text = text or ""
    done = 0
    for at, end in spans(text):
        if at < done:
            continue
        try:
            x = json.loads(text[at:end])
        except (ValueError, RecursionError):
            continue  # the objects inside are looked at by themselves
        if "id" in x:
            done = end
            yield x
        else:
            inner = next((v for v in x.values() if isinstance(v, list) and any(isinstance(o, dict) and "id" in o for o in v)), None)
            if inner is not None:
                done = end
                yield from (o for o in inner if isinstance(o, dict) and "id" in o)


@udtf(returnType="id string, label string")
class Replies:
    """A reply's labels as rows: the id as text and the other fields as JSON."""

    def eval(self, text: str):
        for x in answers(text):
            yield str(x["id"]), json.dumps({k: v for k, v in x.items() if k != "id"})


def read_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Replies with a row for each label: the other columns, id and label (JSON). Replies without one have no row."""
    spark = replies.sparkSession
    spark.udtf.register("tidemark_replies", Replies)
    rest = ", ".join(f"r.`{c}`" for c in replies.columns if c != column)
    return spark.sql(f"SELECT {rest + ', ' if rest else ''}x.id, x.label FROM {{r}} r, LATERAL tidemark_replies(r.`{column}`) x", r=replies)


def ask_all(rows: list[dict], key: str, ask: Callable[[list[dict]], str], size: int, waits: Iterable[float], sleep: Callable[[float], None], state: dict) -> Iterator[tuple[dict, str | None, str | None]]:
    """(row, label as JSON, error) for each row, one of the two null."""
    todo = deque(rows[k : k + size] for k in range(0, len(rows), size))
    while todo:
        batch = todo.popleft()
        if state.get("aborted"):
            yield from ((r, None, ABORTED) for r in batch)
            continue
        error, got = NO_LABEL, {}
        for wait in [*waits, None]:
            try:
                got = {str(x["id"]): x for x in answers(ask(batch))}
                error = NO_LABEL
            except Exception as e:  # whatever a model's client raises
                error = f"{type(e).__name__}: {e}"[:500]
                if any(h in error.lower() for h in THROTTLED):
                    if wait is not None:
                        sleep(wait)
                        continue
                    state["aborted"] = True
            break
        if state.get("aborted"):
            todo.appendleft(batch)
            continue
        missing = [r for r in batch if str(r[key]) not in got]
        for r in batch:
            x = got.get(str(r[key]))
            if x is not None:
                yield r, json.dumps({k: v for k, v in x.items() if k != "id"}), None
        if len(missing) == 1:
            yield missing[0], None, error
        elif len(missing) == len(batch):
            half = len(batch) // 2
            todo.extendleft([batch[half:], batch[:half]])
        elif missing:
            todo.appendleft(missing)


def asked(items: DataFrame, ask: Callable[[list[dict]], str], label: str, key: str = "seq", size: int = 8, tasks: int | None = None, waits: Iterable[float] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Items with label (a struct of the schema ``label``, null without one), rationale and label_error.

    ``key`` tells all items apart. ``ask`` gets up to ``size`` items as dicts and returns the model's reply: objects with
    the item's key as id. If given, ``tasks`` is how many tasks ask side by side, each with batches, halves and waits of
    its own. A task holds one Arrow batch of items at a time. What comes back should be saved before it is used twice, as each use asks
    again."""
    rows = items.drop("rationale", "label_error")
    waits = tuple(waits)
    kind = f"`{key}` {dict(rows.dtypes)[key]}, __label string, label_error string"
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in it:
            told = [(r[key], x, e) for r, x, e in ask_all(batch.to_pylist(), key, ask, size, waits, sleep, state)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, t, strict=True)) for t in told], schema=schema)

    said = (rows.repartition(tasks) if tasks else rows).mapInArrow(run, kind)
    said = said.withColumn("label", F.from_json("__label", label)).withColumn("rationale", F.get_json_object("__label", "$.rationale"))
    return rows.join(said.drop("__label"), key)
