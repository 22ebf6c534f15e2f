"""The commands: run, replay, relabel, backtest, diff, merge, verify, rescore, golden.

A run takes the sentiment pass through the sampler and adds what the other passes have that it hasn't: results prints,
governance candidates, filings and exchange actions. Items become events, events take their labels from the cache, the
corpus or the labeller (twice where it gave none), rejected labels go with a reason, and governance events that earlier
runs stored and this one didn't find join in. All is scored once and appended to the corpus of record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.timing import window_of
from .operators import asking, cluster, corpus, label, sample, score, sweep, views
from .operators import governance as gov
from .operators import sentiment as sen
from .plans.rubric import DEFAULT, Rubric
from .sources.scratch import Scratch

SCORES = ["sentiment_mean", "governance_score", "risk_score", "opportunity_score"]
LOOKBACK = 365
#: Columns of stored evidence: all that scoring reads.
EVIDENCE = (
    "symbol company sector seq title snippet url source published event_date kind win purpose pass_ relevance n_sources n_members max_tier confidence sources url_hashes event_id event_type sentiment rationale "
    "governance_flag materiality historical substance subject occurred_at_company action_stage severity amount_inr_cr people_direction role_tier event_key ca_stage ca_size_pct ca_days_to_effective penalty_override "
    "model prompt_version"
).split()
KINDS = {
    "sentiment": "int", "governance_flag": "boolean", "historical": "boolean", "occurred_at_company": "boolean", "amount_inr_cr": "double", "ca_size_pct": "double", "ca_days_to_effective": "double",
    "penalty_override": "double", "confidence": "double", "published": "date", "event_date": "date", "seq": "long", "win": "int", "relevance": "int", "n_sources": "long", "n_members": "long", "url_hashes": "array<string>", "sources": "array<string>",
}
Labeller = Callable[[DataFrame], DataFrame]


def run_id(as_of: str, now: datetime | None = None, tag: str = "") -> str:
    now = now or datetime.now(timezone.utc)
    return f"{as_of}{tag}_{now:%Y%m%dT%H%M%S}{now.microsecond // 1000:03d}"


def with_columns(df: DataFrame) -> DataFrame:
    """Evidence with all its columns, those that are missing as nulls."""
    return df.select(*[F.col(c).cast(KINDS.get(c, "string")).alias(c) if c in df.columns else F.lit(None).cast(KINDS.get(c, "string")).alias(c) for c in EVIDENCE])


def keyword_labeller(items: DataFrame) -> DataFrame:
    """Adds a label by rules on the text; items have company, the company's name."""
    return items.withColumn("label", label.keyword_label(F.col("title"), F.col("snippet"), F.col("company"))).withColumn("rationale", F.lit("keyword rule"))


def stored_labels(new: DataFrame, model: str, prompt: str) -> DataFrame:
    return new.select("item_key", "url_hash", "label", "rationale", F.lit(model).alias("model"), F.lit(prompt).alias("prompt_version"))


def batched(label_rows: Callable, schema: str) -> Labeller:
    """A labeller from a function over pandas batches, for a model that labels many items a call. It returns the
    batch with the columns of ``schema`` too."""

    def apply(items: DataFrame) -> DataFrame:
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
        return items.mapInPandas(lambda it: (label_rows(b) for b in it), f"{own}, {schema}")

    return apply


@dataclass
class Run:
    scores: DataFrame
    evidence: DataFrame
    dropped: DataFrame
    merged: DataFrame  # rows that are part of another event, with the row that stands for it and when they were merged


class Engine:
    def __init__(self, spark: SparkSession, root: str, rubric: Rubric = DEFAULT):
        self.spark, self.r = spark, rubric
        self.corpus = corpus.Corpus(spark, root)

    def named(self, holdings: DataFrame, items: DataFrame) -> DataFrame:
        """Items of the holdings, with name and sector, the company's own words and whether the title names the company."""
        cols = [c for c in ("name", "sector") if c in holdings.columns]
        said = [F.col(c) for c in ("name", "symbol", "aliases") if c in holdings.columns]
        own = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *said)), F.lit("[a-z0-9]{2,}"), F.lit(0)))
        rows = items.join(views.name_tokens(holdings), "symbol").join(holdings.select("symbol", *cols, own.alias("own")), "symbol")
        rows = rows.withColumn("usable", tx.title_hit(F.col("title"), F.col("name_tokens"))).drop("name_tokens")
        return rows if "relevance" in rows.columns else rows.withColumn("relevance", F.lit(0))

    def passes(self, holdings: DataFrame, items: DataFrame, as_of: Column, more: dict[str, DataFrame], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(kept, dropped): the union of the passes, each without the urls and titles that those before it have."""
        picked = scratch.save(sample.drop_reasons(sample.stratified(self.named(holdings, items), as_of, capped=False, r=self.r)))
        names = ["symbol", "seq", "title", "snippet", "url", "source", "published", "name", "sector", "own", "relevance", "win"]
        told = lambda rows, pass_, purpose, kind="news": rows.select(*names).withColumns({"pass_": F.lit(pass_), "purpose": F.lit(purpose), "kind": F.lit(kind)})
        kept = told(picked.where("reason is null"), "sentiment", "sentiment")
        windowed = lambda rows: rows.withColumn("win", window_of(F.col("published"), as_of, self.r))
        if "results" in more:
            rows = self.named(holdings, more["results"]).where(F.col("usable") & tx.results_title(F.col("title")))
            rows = sample.results_buckets(windowed(sample.unseen(rows, kept)).where("win is not null"), as_of, self.r)
            kept = scratch.save(kept.unionByName(told(rows, "results", "sentiment")))
        if "governance" in more:
            rows = sample.governance_pass(self.named(holdings, more["governance"]), kept, as_of, r=self.r)
            kept = scratch.save(kept.unionByName(told(rows, "governance", "governance")))
        if "filings" in more:
            rows = sample.unseen(self.named(holdings, sample.unique_filings(more["filings"])), kept)
            gov_ = tx.governance_title(F.col("title")) & ~tx.results_title(F.col("title"))
            rows = told(windowed(rows).where("win is not null"), "filings", "sentiment")
            kept = scratch.save(kept.unionByName(rows.withColumn("purpose", F.when(gov_, "governance").otherwise("sentiment"))))
        if "actions" in more:
            rows = windowed(sample.dedupe_by_url(self.named(holdings, more["actions"]), ["symbol"])).where("win is not null")
            kept = scratch.save(kept.unionByName(told(rows, "actions", "sentiment", "action")))
        told_why = picked.where("reason is not null").select("symbol", "seq", "title", "url", "published", "win", "reason")
        cols = ["symbol", "seq", "title", "url", "published"]
        every = items.select(*cols)
        for rows in more.values():
            every = every.unionByName(rows.select(*cols))
        # what a pass left out without a word: copies of a url or title, other holdings' items, and titles that it doesn't look for
        rest = every.join(kept.select("seq"), "seq", "left_anti").join(told_why.select("seq"), "seq", "left_anti")
        rest = windowed(rest).withColumn("reason", F.lit("a copy of another item or not what its pass looks for"))
        return kept, told_why.unionByName(rest.select(*told_why.columns))

    def events(self, kept: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(events, members): items clustered, each event by its representative: one label an event is all that follows,
        so this comes before the labeller. Members are the other items, each with the one that stands for it. Actions of
        an exchange are events as they are."""
        news, acts = kept.where("kind = 'news'"), kept.where("kind <> 'news'").withColumn("cluster", F.col("seq"))
        grouped = news.join(cluster.clusters(news, self.r, F.col("own")), "seq").unionByName(acts)
        built = scratch.save(cluster.build_events(grouped, self.r, members=False))
        others = grouped.join(built.select("symbol", "cluster", F.col("seq").alias("into")), ["symbol", "cluster"]).where("seq <> into")
        members = others.select("symbol", "seq", "title", "url", "published", "win", "into", F.lit("before labelling").alias("step"))
        rest = kept.select("seq", "sector", "snippet", "source", "win", "relevance", "pass_", "purpose", "kind", F.col("name").alias("company"))
        return built.join(rest, "seq"), members

    def labels(self, events: DataFrame, labeller: Labeller, model: str, prompt: str, scratch: Scratch, run: str) -> tuple[DataFrame, DataFrame]:
        """(events with label and rationale, the new labels): from the cache by item, from the corpus by url, then from
        the labeller, which is asked once more for what it left out. Where a model's throttling goes on, the labels that
        came are stored and the run ends; the next one asks for the rest."""
        keyed = events.withColumn("item_key", tx.item_key(F.col("url"), F.col("title"), F.col("snippet"), F.lit(model), F.lit(prompt)))
        keyed = keyed.withColumn("url_hash", tx.url_hash(F.col("url"))).withColumn("member_hashes", F.col("url_hashes"))
        own = labeller(events.limit(0)).schema["label"].dataType.simpleString()  # as text, which leaves out what can't be null
        kind = f"struct<label:{own},rationale:string>"
        if self.corpus.runs("labels"):
            known = self.corpus.read("labels").where((F.col("model") == model) & (F.col("prompt_version") == prompt))
            told = known.select("item_key", "url_hash", "run_id", F.struct("label", "rationale").cast(kind).alias("label"))
            by = lambda key: told.groupBy(key).agg(F.max_by("label", "run_id").alias("label"))
            keyed = label.from_cache(keyed, by("item_key"), by("url_hash"))
        else:
            keyed = keyed.withColumn("label", F.lit(None).cast(kind)).withColumn("label_source", F.lit("label"))
        keyed = scratch.save(keyed)
        have = keyed.where("label is not null").select(*[c for c in keyed.columns if c != "label"], "label.label", "label.rationale")
        todo = keyed.where("label is null").drop("label")
        if not todo.head(1):
            return have, todo.withColumn("label", F.lit(None).cast(own)).withColumn("rationale", F.lit("")).limit(0)
        first = scratch.save(labeller(todo))
        missing = first.where("label is null").select(*todo.columns)
        new = first.where("label is not null")
        if "label_error" in first.columns and first.where(F.col("label_error") == asking.ABORTED).head(1):
            part = f"{run}_{run_id('labels')}"
            self.corpus.append("labels", stored_labels(new, model, prompt), part)
            raise asking.LabellingAborted(f"the model kept throttling; the labels that came are stored as {part}")
        if missing.head(1):
            new = scratch.save(new.unionByName(labeller(missing).select(*first.columns)))
        return have.unionByName(new.select(*have.columns)), new.where("label is not null")

    def run(
        self, holdings: DataFrame, items: DataFrame, as_of: str, labeller: Labeller = keyword_labeller, verified: DataFrame | None = None, run: str | None = None,
        more: dict[str, DataFrame] | None = None, model: str = "keyword", prompt: str = "v1", locked: DataFrame | None = None, confirmed: bool = False, golden: DataFrame | None = None,
    ) -> Run:
        """Scores a portfolio and appends the run to the corpus. Items: symbol, seq, title, snippet, url, source,
        published; ``more`` has such items by pass (results, governance, filings, actions), with numbers of their own.
        Verified rows, with evidence's columns, are added before scoring. Labels are kept by ``model`` and ``prompt``.
        A change of the ``locked`` universe must be confirmed, and every ``golden`` case must hold. Each item is in the
        evidence, dropped with a reason or merged into another; news alone is merged after labelling."""
        if locked is not None and not confirmed:
            changes = [f"{r.symbol} {r.change}" for r in corpus.universe_changes(holdings, locked).orderBy("symbol").limit(20).collect()]
            if changes:
                raise ValueError(f"the universe changed and the change isn't confirmed: {', '.join(changes)}")
        if golden is not None:
            wrong = [r.id for r in self.golden(golden).where("not ok").limit(20).collect()]
            if wrong:
                raise ValueError(f"golden cases fail under this rubric: {', '.join(wrong)}")
        day = F.lit(as_of).cast("date")
        scratch = Scratch(self.spark, "run")
        run = run or run_id(as_of)
        if run in self.corpus.runs("manifests"):
            raise ValueError(f"run {run} is already in events")
        kept, dropped = self.passes(holdings, items, day, more or {}, scratch)
        built, members = self.events(kept, scratch)
        told, new = self.labels(scratch.save(built), labeller, model, prompt, scratch, run)
        done = told.select("*", "label.*").withColumn("labelled", F.col("label").isNotNull()).drop("label")
        checked = scratch.save(label.validated(done, day, LOOKBACK, self.r))
        bad = checked.where("reason is not null").select("symbol", "seq", "title", "url", "published", "win", "reason")
        good = label.price_lint(checked.where("reason is null")).withColumns({"model": F.lit(model), "prompt_version": F.lit(prompt)})
        good = scratch.save(with_columns(good))
        news = good.where("kind = 'news'")
        merged = scratch.save(cluster.merge_labelled(news, self.r))
        pooled = merged.where("seq = survivor").select("seq", *cluster.POOLED)
        kept = news.drop(*cluster.POOLED).join(pooled, "seq").unionByName(good.where("kind <> 'news'"))
        later = news.join(merged.where("seq <> survivor").select("seq", F.col("survivor").alias("into")), "seq")
        absorbed = scratch.save(members.unionByName(later.select("symbol", "seq", "title", "url", "published", "win", "into", F.lit("after labelling").alias("step"))))
        kept = scratch.save(kept)
        if self.corpus.runs("events"):
            kept = kept.unionByName(self.stored(kept, holdings, day, model, prompt).select(*kept.columns))
        if verified is not None:
            named = verified.drop("company").join(holdings.select("symbol", F.col("name").alias("company")), "symbol", "left") if "name" in holdings.columns else verified
            kept = kept.unionByName(with_columns(named).select(*kept.columns))
        evidence = scratch.save(with_columns(kept))
        gone = scratch.save(dropped.unionByName(bad))
        scores = scratch.save(score.score_portfolio(holdings.select("symbol", "sector"), evidence, day, self.r))
        seen = [F.col(c) for c in ("symbol", "seq", "url", "published", "win")]
        why = lambda c: c.cast("string").alias("reason")
        into = F.concat(F.lit("merged into "), F.col("into").cast("string"))
        names = [F.col(c) if c in holdings.columns else F.lit(None).cast("string").alias(c) for c in ("symbol", "name", "sector")]
        told_as = [day.alias("as_of"), F.lit(self.r.sha).alias("rubric"), F.lit("live").alias("mode"), F.current_date().alias("fetched"), F.lit(model).alias("model"), F.lit(prompt).alias("prompt_version")]
        tables = {
            "events": evidence.withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("v"), F.col("seq").cast("string")))),
            "scores": scores.withColumn("as_of", day),
            "articles": gone.select(*seen, "reason").unionByName(absorbed.select(*seen, why(into))).unionByName(evidence.select(*seen, why(F.lit(None)))),
            "labels": stored_labels(new, model, prompt),
            "holdings": holdings.select(*names),
            "manifests": self.spark.range(1).select(*told_as),
        }
        self.corpus.publish(tables, run)
        return Run(scores, evidence, gone, absorbed)

    def stored(self, kept: DataFrame, holdings: DataFrame, as_of: Column, model: str, prompt: str) -> DataFrame:
        """Governance events that earlier runs of the same model and prompt stored, a date could see and this run
        doesn't have, with their reasons."""
        seen = corpus.visible_events(self.corpus.read("events"), self.corpus.read("manifests"), as_of, self.r)
        same = (F.col("model") == model) & (F.col("prompt_version") == prompt) & (F.trim(F.coalesce("rationale", F.lit(""))) != "")
        rows = seen.where(same & (F.coalesce("pass_", F.lit("")) != "verified")).join(holdings.select("symbol"), "symbol", "left_semi")
        found = corpus.missing_events(kept, rows, as_of, LOOKBACK)
        return with_columns(found.withColumns({"purpose": F.lit("governance"), "pass_": F.lit("governance"), "win": window_of(F.col("published"), as_of, self.r), "seq": -F.abs(F.xxhash64("event_id"))}))

    def holdings_of(self, symbols: DataFrame) -> DataFrame:
        """Symbols as the newest stored run that lists them has them."""
        return corpus.stored_holdings(self.corpus.read("holdings"), symbols)

    def previous(self, before: str | None = None) -> str | None:
        """The newest stored run, or the newest before a run."""
        runs = sorted(r for r in self.corpus.runs("scores") if before is None or r < before)
        return runs[-1] if runs else None

    def replay(self, holdings: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
        """The scores that a date could have had, from what was stored."""
        by = lambda rows, day: score.score_portfolio(holdings.select("symbol", "sector"), rows.withColumn("win", window_of(F.col("published"), day, self.r)), day, self.r)
        return corpus.replay(self.corpus.read("events"), self.corpus.read("manifests"), as_of, by, self.r, strict)

    def relabel(self, run: str, labeller: Labeller, company: DataFrame) -> DataFrame:
        """Stored events of a run with new labels; all other columns stay."""
        rows = self.corpus.read("events", [run]).drop("company").join(company.select("symbol", F.col("name").alias("company")), "symbol")
        fields = [f.name for f in labeller(rows.limit(0)).schema["label"].dataType.fields]
        return with_columns(labeller(rows).drop(*[f for f in fields if f in rows.columns]).select("*", "label.*"))

    def series(self, start: str, end: str, step_days: int = 1, strict: bool = False) -> DataFrame:
        """(as_of, symbol, n_events, n_signal, weighted_mean, weighted_band) at each date, by running sums: the work doesn't
        grow with the dates, only the rows that come out."""
        spans = sweep.mean_intervals(self.corpus.read("events"), self.corpus.read("manifests"), start, end, self.r, strict=strict)
        return sweep.at_dates(spans, start, end, step_days)

    def backtest(self, start: str, end: str, step_days: int = 7, strict: bool = False) -> DataFrame:
        """All scores at each date, all dates in one job. An event after its date fails the job."""

        def scored(rows: DataFrame, by: list[str]) -> DataFrame:
            # a symbol and a sector of one date are keys of their own
            at = lambda c: F.concat(c, F.lit(gov.AT), F.col("as_of").cast("string")).alias(c)
            fair = F.assert_true(F.col("event_date") <= F.col("as_of"), "an event after the date it is scored at").isNull()
            rows = rows.where(fair).withColumn("win", window_of(F.col("published"), F.col("as_of"), self.r))
            rows = rows.select(*[at(c) if c in ("symbol", "sector") else F.col(c) for c in rows.columns])
            held = rows.groupBy("symbol").agg(F.min("sector").alias("sector"))
            out = score.score_portfolio(held, rows, F.col("as_of"), self.r)
            cut = lambda c: F.substring_index(c, gov.AT, 1).alias(c)
            return out.select(F.substring_index("symbol", gov.AT, -1).cast("date").alias("as_of"), cut("symbol"), cut("sector"), *[c for c in out.columns if c not in ("symbol", "sector")])

        return corpus.backtest(self.corpus.read("events"), self.corpus.read("manifests"), start, end, step_days, scored, self.r, strict)

    def scores(self, run: str) -> DataFrame:
        return self.corpus.read("scores", [run])

    def seal(self, run: str) -> DataFrame:
        """Stores the digests of a run's tables; returns those of its tables and of the run."""
        self.corpus.seal(run)
        return self.corpus.read("audit", [run]).where("level in ('folder', 'root')").orderBy("name")

    def diff(self, a: str, b: str) -> DataFrame:
        return corpus.diff(self.scores(a), self.scores(b), SCORES)

    def drivers(self, a: str, b: str, as_of: str) -> DataFrame:
        """Codes for what makes two runs differ."""
        day = F.lit(as_of).cast("date")
        sides = []
        for run in (a, b):
            rows = self.corpus.read("events", [run])
            span = sen.evidence_standard(rows, ["symbol"], self.r).select("symbol", "span_days")
            sides.append((self.scores(run).join(span, "symbol", "left"), gov.penalties(rows, day, self.r)))
        return corpus.driver_codes(sides[0][0], sides[1][0], sides[0][1], sides[1][1])

    def rescore(self, run: str, holdings: DataFrame, as_of: str) -> DataFrame:
        """The stored evidence of a run under this engine's rubric."""
        day = F.lit(as_of).cast("date")
        return score.score_portfolio(holdings.select("symbol", "sector"), self.corpus.read("events", [run]).withColumn("win", window_of(F.col("published"), day, self.r)), day, self.r)

    def verify(self, run: str, holdings: DataFrame, as_of: str) -> DataFrame:
        """Symbols whose stored scores differ from recomputed ones: none if the run can be reproduced."""
        return corpus.verify(self.scores(run), self.rescore(run, holdings, as_of), SCORES)

    def merge(self, a: str, b: str, holdings: DataFrame, as_of: str) -> DataFrame:
        """Two runs' evidence united and scored once."""
        day = F.lit(as_of).cast("date")
        both = corpus.merge(with_columns(self.corpus.read("events", [a])), with_columns(self.corpus.read("events", [b])))
        return score.score_portfolio(holdings.select("symbol", "sector"), both, day, self.r)

    def golden(self, cases: DataFrame) -> DataFrame:
        return score.golden(cases, self.r)

    def governance_of(self, events: DataFrame, as_of: str) -> DataFrame:
        """The governance score of events given by hand."""
        return gov.governance(events, events, F.lit(as_of).cast("date"), self.r)
