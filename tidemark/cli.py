"""Commands over the engine: tables come in and go out as files that Spark reads and writes."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import learn, score, views
from .plans.rubric import DEFAULT, load_rubric


def table(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its ending: parquet, JSON lines or CSV with a header."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith((".csv", ".tsv")):
        return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--corpus", default="corpus", help="root of the corpus of record")
    p.add_argument("--rubric", help="JSON file of overrides")
    p.add_argument("--out", help="folder for the result as parquet; without it the result is shown")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **optional: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, about in optional.items():
            c.add_argument(f"--{k.replace('_', '-')}", help=about)
        return c

    run = command("run", "holdings", "items", "as_of", run="its id", results="items of this pass", governance="items of this pass", filings="items of this pass", actions="items of this pass", verified="verified rows", locked="the universe as it was confirmed", golden="cases that must hold")
    run.add_argument("--confirmed", action="store_true", help="a change of the universe is meant")
    command("replay", "holdings", "as_of").add_argument("--strict", action="store_true")
    command("relabel", "run", "holdings")
    for name, step in (("backtest", 7), ("series", 1)):
        c = command(name, "start", "end")
        c.add_argument("--step", type=int, default=step)
        c.add_argument("--strict", action="store_true", help="without runs fetched after a date's grace")
    command("diff", "a", "b")
    command("drivers", "a", "b", "as_of")
    command("merge", "a", "b", "holdings", "as_of")
    command("verify", "run", "holdings", "as_of")
    command("rescore", "run", "holdings", "as_of")
    command("golden", "cases")
    command("governance", "events", "as_of")
    command("render", "run")
    command("runs")
    command("seal", "run")
    command("tampered", "run")
    command("inspect", "what", "path", holdings="names for titles")
    command("propose", "run", "holdings", "as_of", registry="lessons so far")
    return p


def inspect(spark: SparkSession, e: Engine, what: str, path: str, holdings: str | None) -> DataFrame:
    """What a step makes of a file: input (holdings with the words that tie titles to them), news or filings (items
    with the companies that their titles name), label (items with the keyword labels)."""
    rows = table(spark, path)
    if what == "input":
        return views.name_tokens(rows)
    if what in ("news", "filings"):
        return e.named(table(spark, holdings), rows) if holdings else rows
    if what == "label":
        from .engine import keyword_labeller

        return keyword_labeller(rows if "company" in rows.columns else rows.withColumn("company", F.col("symbol"))).select("*", "label.*").drop("label")
    raise SystemExit(f"inspect: {what} is none of input, news, filings, label")


def proposals(spark: SparkSession, e: Engine, a: argparse.Namespace) -> DataFrame:
    from .operators import governance, sentiment

    rows = e.corpus.read("events", [a.run])
    day = F.lit(a.as_of).cast("date")
    found = score.anomalies(e.scores(a.run), governance.penalties(rows, day, e.r), rows, rows.withColumn("labelled", F.lit(True)), sentiment.evidence_standard(rows, ["symbol"], e.r), e.r)
    return learn.propose(found, table(spark, a.registry) if a.registry else spark.createDataFrame([], learn.REGISTRY))


def execute(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    r = DEFAULT
    if a.rubric:
        with open(a.rubric, encoding="utf-8") as f:
            r = load_rubric(json.load(f))
    e = Engine(spark, a.corpus, r)
    get = lambda name: table(spark, getattr(a, name)) if getattr(a, name, None) else None
    if a.command == "run":
        more = {k: get(k) for k in ("results", "governance", "filings", "actions") if getattr(a, k)}
        return score.ordered(e.run(get("holdings"), get("items"), a.as_of, verified=get("verified"), run=a.run, more=more, locked=get("locked"), confirmed=a.confirmed, golden=get("golden")).scores)
    if a.command == "relabel":
        from .engine import keyword_labeller

        return e.relabel(a.run, keyword_labeller, get("holdings"))
    return {
        "replay": lambda: e.replay(get("holdings"), a.as_of, a.strict),
        "backtest": lambda: e.backtest(a.start, a.end, a.step, a.strict),
        "series": lambda: e.series(a.start, a.end, a.step, a.strict),
        "diff": lambda: e.diff(a.a, a.b),
        "drivers": lambda: e.drivers(a.a, a.b, a.as_of),
        "merge": lambda: e.merge(a.a, a.b, get("holdings"), a.as_of),
        "verify": lambda: e.verify(a.run, get("holdings"), a.as_of),
        "rescore": lambda: e.rescore(a.run, get("holdings"), a.as_of),
        "golden": lambda: e.golden(get("cases")),
        "governance": lambda: e.governance_of(get("events"), a.as_of),
        "render": lambda: score.ordered(e.scores(a.run)),
        "runs": lambda: e.corpus.read("manifests").select("run_id", "as_of", "rubric", "mode", "fetched").orderBy("run_id"),
        "seal": lambda: e.seal(a.run),
        "tampered": lambda: e.corpus.tampered(a.run).orderBy("level", "name"),
        "inspect": lambda: inspect(spark, e, a.what, a.path, a.holdings),
        "propose": lambda: proposals(spark, e, a),
    }[a.command]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = execute(spark, a)
    if a.out:
        out.write.mode("errorifexists").parquet(a.out)
    else:
        out.show(100, truncate=False)
