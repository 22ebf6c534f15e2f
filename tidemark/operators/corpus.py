"""The corpus of record: append-only tables by run, point-in-time views, replay, backtest, comparison of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rubric import DEFAULT, Rubric
from ..sources import audit
from ..sources.scratch import Scratch
from .sweep import lives


class Corpus:
    """Parquet tables under a root, one partition for each run; a run is written once.

    ``publish`` writes a run's tables behind a marker and takes the marker away at the end. Readers leave out runs that
    have one, so a run is seen with all its tables or not at all; what a failed attempt left goes when the run is
    published again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _written(self, name: str) -> set[str]:
        p, fs = self._at(self.path(name))
        if not fs.exists(p):
            return set()
        return {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if "=" in s.getPath().getName()}

    def unfinished(self) -> set[str]:
        """Runs whose tables are being written, or were when their writer failed."""
        return self._written("_unfinished")

    def runs(self, name: str) -> set[str]:
        """The run ids of a table that can be seen, from its directories."""
        return self._written(name) - self.unfinished()

    def append(self, name: str, rows: DataFrame, run_id: str) -> None:
        if run_id in self.runs(name):
            raise ValueError(f"run {run_id} is already in {name}")
        rows.drop("run_id").write.parquet(f"{self.path(name)}/run_id={run_id}")

    def publish(self, tables: dict[str, DataFrame], run_id: str) -> None:
        """Writes a run's tables so that they are seen together. A run id has one writer at a time."""
        marker, fs = self._at(f"{self.path('_unfinished')}/run_id={run_id}")
        left = fs.exists(marker)
        for name in tables:
            if left:
                fs.delete(self._at(f"{self.path(name)}/run_id={run_id}")[0], True)
            elif run_id in self._written(name):
                raise ValueError(f"run {run_id} is already in {name}")
        fs.mkdirs(marker)
        for name, rows in tables.items():
            rows.drop("run_id").write.parquet(f"{self.path(name)}/run_id={run_id}")
        fs.delete(marker, True)

    def _blocks(self, run_id: str) -> DataFrame:
        blocks = audit.leaves(self.spark, self.root, f"*/run_id={run_id}").where("not startswith(name, 'audit/')")
        return Scratch(self.spark, "seal").save(blocks)

    def seal(self, run_id: str) -> None:
        """Stores the digests of a run's tables as they are: blocks, files, tables and the run."""
        self.append("audit", audit.tree(self._blocks(run_id), 2), run_id)

    def tampered(self, run_id: str) -> DataFrame:
        """(level, name, change): what has changed in a run's tables since it was sealed."""
        return audit.changes(self.read("audit", [run_id]), audit.tree(self._blocks(run_id), 2))

    def read(self, name: str, runs: list[str] | None = None) -> DataFrame:
        out = self.spark.read.option("mergeSchema", True).parquet(self.path(name)).withColumn("run_id", F.col("run_id").cast("string"))
        hidden = self.unfinished()
        if hidden:
            out = out.where(~F.col("run_id").isin(*hidden))
        return out if runs is None else out.where(F.col("run_id").isin(*runs))


def visible_runs(manifests: DataFrame, as_of: Column, r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    """Runs that could be known at a date: theirs is at most the grace later, they are no replays, and, if strict, they
    were fetched within the grace too."""
    limit = F.date_add(as_of, r["pit_grace_days"])
    out = manifests.where((F.col("as_of") <= limit) & (F.coalesce("mode", F.lit("")) != "pit-replay"))
    return out.where(F.col("fetched") <= limit) if strict else out


def latest_copy(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each event as the latest run has it. A limit by rank: rows that a task of the scan can tell to be older go before
    the shuffle, and columns that aren't asked for aren't carried."""
    last = Window.partitionBy(*(by or []), "event_id").orderBy(F.col("run_id").desc())
    return events.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def visible_events(events: DataFrame, manifests: DataFrame, as_of: Column, r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    """The latest copies of the events that could be known at a date. Runs are few and hold all events between them, so
    they are broadcast: a shuffle by run would have a task for each run."""
    runs = visible_runs(manifests, as_of, r, strict).select("run_id")
    return latest_copy(events.join(F.broadcast(runs), "run_id", "left_semi").where(F.col("event_date") <= as_of))


def replay(events: DataFrame, manifests: DataFrame, as_of: str, score: Callable[[DataFrame, Column], DataFrame], r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return score(visible_events(events, manifests, day, r, strict), day)


def backtest(events: DataFrame, manifests: DataFrame, start: str, end: str, step_days: int, score: Callable[[DataFrame, list[str]], DataFrame], r: Rubric = DEFAULT, strict: bool = False) -> DataFrame:
    """Scores at each date from start to end in one job: each copy of an event is given to the dates at which it is the
    latest that can be seen (``sweep.lives``), and ``score`` groups by as_of too. No date sees an event after it, nor, if
    strict, a run fetched after its grace. For means alone over many dates ``sweep.mean_intervals`` makes no row for each
    date."""
    dates = events.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL {step_days} DAY)) AS as_of")
    shown = (F.col("since") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until")))
    return score(lives(events, manifests, r, strict).join(F.broadcast(dates), shown).drop("since", "until"), ["as_of"])


def delta(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Each symbol's values now, before and their change; new symbols have no before."""
    old = before.select("symbol", *[F.col(c).alias(f"{c}_before") for c in columns])
    out = now.select("symbol", *columns).join(old, "symbol", "left")
    return out.select("*", *[(F.col(c) - F.col(f"{c}_before")).alias(f"{c}_change") for c in columns])


def penalty_map(penalties: DataFrame) -> DataFrame:
    return penalties.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "eff")))).alias("pen"))


def diff(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Two runs side by side: values, whether they agree, and a code: U one side only, = all equal, C otherwise."""
    x = a.select("symbol", *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("in_a"))
    y = b.select("symbol", *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    out = x.join(y, "symbol", "full_outer")
    same = None
    for c in columns:
        p, q = F.col(f"{c}_a"), F.col(f"{c}_b")
        equal = F.coalesce(F.abs(p - q) <= tolerance, p.isNull() & q.isNull())
        out = out.withColumn(f"{c}_same", equal)
        same = F.col(f"{c}_same") if same is None else same & F.col(f"{c}_same")
    code = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "U").when(same, "=").otherwise("C")
    return out.withColumn("code", code).drop("in_a", "in_b")


def driver_codes(a: DataFrame, b: DataFrame, penalties_a: DataFrame, penalties_b: DataFrame, linted: bool = False) -> DataFrame:
    """(symbol, drivers): what makes two runs differ, as "agree" or codes in a row.

    Scores have sentiment_band, governance_score, note and span_days. U: only one run has the symbol. C: a penalty in
    one run only. M: another weight of a penalty. For another sentiment band R: a run lacked evidence or the spans
    differ by more than 90 days, else P: price language was taken out of a rationale (``linted``), else L: labels."""
    cols = ("sentiment_band", "governance_score", "note", "span_days")
    x, y = (rows.select("symbol", *[F.col(c).alias(f"{c}_{n}") for c in cols], F.lit(True).alias(f"in_{n}")) for rows, n in ((a, "a"), (b, "b")))
    changed = penalty_changes(penalties_a, penalties_b).groupBy("symbol").agg(F.collect_set("change").alias("changes"))
    out = x.join(y, "symbol", "full_outer").join(changed, "symbol", "left")
    gov = ~F.col("governance_score_a").eqNullSafe(F.col("governance_score_b"))
    has = lambda c: F.coalesce(F.array_contains("changes", c), F.lit(False))
    lacks = F.concat(F.coalesce("note_a", F.lit("")), F.coalesce("note_b", F.lit("")))
    reach = (lacks != "") | F.coalesce(F.abs(F.col("span_days_a") - F.col("span_days_b")) > 90, F.lit(False))
    mood = ~F.col("sentiment_band_a").eqNullSafe(F.col("sentiment_band_b"))
    codes = F.array_compact(
        F.array(
            F.when(gov & (has("only in a") | has("only in b")), "C"),
            F.when(gov & has("changed"), "M"),
            F.when(mood, F.when(reach, "R").when(F.lit(linted), "P").otherwise("L")),
        )
    )
    one = F.col("in_a").isNull() | F.col("in_b").isNull()
    return out.select("symbol", F.when(one, "U").when(F.size(codes) > 0, F.array_join(codes, "")).otherwise("agree").alias("drivers"))


def stored_holdings(listed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, name, sector): each symbol's holding as the newest run that lists it has it. Symbols that none lists are
    named after themselves. ``listed`` has run_id, symbol, name and sector."""
    last = listed.groupBy("symbol").agg(F.max_by(F.struct("name", "sector"), "run_id").alias("x"))
    out = symbols.select("symbol").distinct().join(last, "symbol", "left")
    return out.select("symbol", F.coalesce("x.name", "symbol").alias("name"), F.coalesce("x.sector", F.lit("Unclassified")).alias("sector"))


def agreement(diffed: DataFrame, columns: list[str]) -> DataFrame:
    both = diffed.where("code <> 'U'")
    return both.agg(F.count(F.lit(1)).alias("n_both"), *[F.avg(F.col(f"{c}_same").cast("double")).alias(f"{c}_agreement") for c in columns])


def penalty_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Penalties by (symbol, event_type), summed up, that only one run has or that differ."""
    x, y = (rows.groupBy("symbol", "event_type").agg(F.sum("eff").alias(c)) for rows, c in ((a, "a"), (b, "b")))
    out = x.join(y, ["symbol", "event_type"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return out.withColumn("change", F.when(F.col("a").isNull(), "only in b").when(F.col("b").isNull(), "only in a").otherwise("changed"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two runs' evidence, each (symbol, url or title) once and from the first run if both have it. It is
    scored once; scores are never averaged."""
    both = a.withColumn("__run", F.lit(0)).unionByName(b.withColumn("__run", F.lit(1)))
    key = F.coalesce(F.nullif(F.trim(F.col("url")), F.lit("")), F.col("title"))
    rest = [c for c in a.columns if c != "symbol"]
    out = both.withColumn("__k", key).groupBy("symbol", "__k").agg(F.min_by(F.struct(*rest), F.struct("__run", "seq")).alias("x"))
    return out.select("symbol", "x.*").select(*a.columns)


def verify(saved: DataFrame, again: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Symbols whose stored scores differ from recomputed ones."""
    return diff(saved, again, columns, tolerance).where("code <> '='")


def missing_events(now: DataFrame, stored: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Stored governance events, the latest copy of each, that share no url hash with this run's and are in the
    lookback. Of stored events that share a hash with each other, the first by (event_date, event_id) stays."""
    rows = stored.where(F.col("governance_flag") & (F.col("event_date") >= F.date_sub(as_of, lookback_days)) & (F.col("event_date") <= as_of))
    have = now.select("symbol", F.explode("url_hashes").alias("h")).distinct()
    own = rows.select("symbol", "event_id", "event_date", F.explode("url_hashes").alias("h"))
    hit = own.join(have, ["symbol", "h"], "left_semi").select("event_id").distinct()
    w = Window.partitionBy("symbol", "h").orderBy("event_date", "event_id")
    later = own.join(hit, "event_id", "left_anti").withColumn("k", F.row_number().over(w)).where("k > 1").select("event_id").distinct()
    return rows.join(hit.unionByName(later).distinct(), "event_id", "left_anti")


def universe_changes(now: DataFrame, locked: DataFrame) -> DataFrame:
    """Symbols added to or removed from the locked list."""
    up = lambda d: d.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    a, b = up(now), up(locked)
    return a.join(b, "symbol", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "symbol", "left_anti").withColumn("change", F.lit("removed")))


def universe_hash(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.upper("symbol"))), "\n"), 256).alias("universe_hash"))
