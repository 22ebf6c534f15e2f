"""Selection of items: url and title copies, the stratified sampler, the candidate passes.

Items have symbol, seq, title, url, published, relevance and usable; a symbol's windows are the only groups that are
sorted, and carries between windows are folded over four counts for each symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import governance_title, is_boilerplate, title_key, url_norm
from ..functions.timing import window_of
from ..plans.rubric import DEFAULT, Rubric


def dedupe_by_url(items: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each url; rows without a url are all kept. One aggregate, whatever a url's number of rows."""
    key = url_norm(F.col("url"))
    rows = items.withColumn("__u", key)
    rest = [c for c in items.columns if c not in (*by, "seq")]
    first = rows.where("__u <> ''").groupBy(*by, "__u").agg(F.min_by(F.struct("seq", *rest), "seq").alias("x"))
    return first.select(*by, "x.*").select(*items.columns).unionByName(rows.where("__u = ''").select(*items.columns))


def collapse_titles(items: DataFrame) -> DataFrame:
    """One row for each title of a symbol, its newest copy (then the most relevant), with n_copies."""
    key = F.coalesce(F.nullif(title_key(F.col("title")), F.lit("")), F.col("url"), F.lit(""))
    rest = [c for c in items.columns if c != "symbol"]
    best = F.max_by(F.struct(*rest), F.struct("published", "relevance", -F.col("seq")))
    out = items.withColumn("__t", key).groupBy("symbol", "__t").agg(best.alias("x"), (F.count(F.lit(1)) - 1).alias("n_copies"))
    return out.select("symbol", "x.*", "n_copies").select(*items.columns, "n_copies")


def newest(by: list[str]) -> object:
    return Window.partitionBy(*by).orderBy(F.col("published").desc(), F.col("relevance").desc(), F.col("seq"))


def filled(counts: Column, quotas: list[int]) -> Column:
    """From an array of the rows at hand in each window: for each the rows wanted and got in the first pass, the rows
    taken in all and the rows looked at, as the shortfall runs to older windows and what is left to the newest."""
    pairs = F.transform(counts, lambda a, i: F.struct(a.alias("have"), F.element_at(F.array(*[F.lit(q) for q in quotas]), i + 1).alias("quota")))
    none = F.expr("cast(array() as array<struct<want:bigint,got:bigint,have:bigint>>)")
    first = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("carry"), none.alias("out")),
        lambda acc, x: F.struct(
            (x["quota"] + acc["carry"] - F.least(x["quota"] + acc["carry"], x["have"])).cast("long").alias("carry"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (x["quota"] + acc["carry"]).cast("long").alias("want"),
                        F.least(x["quota"] + acc["carry"], x["have"]).cast("long").alias("got"),
                        x["have"].cast("long").alias("have"),
                    )
                ),
            ).alias("out"),
        ),
    )
    none = F.expr("cast(array() as array<struct<want:bigint,got:bigint,take:bigint,seen:bigint>>)")
    return F.aggregate(
        first["out"],
        F.struct(first["carry"].alias("left"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["left"] - F.least(acc["left"], x["have"] - x["got"])).cast("long").alias("left"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        x["want"].alias("want"),
                        x["got"].alias("got"),
                        (x["got"] + F.least(acc["left"], x["have"] - x["got"])).cast("long").alias("take"),
                        F.when(acc["left"] > 0, F.greatest(x["want"], x["got"] + acc["left"])).otherwise(x["want"]).cast("long").alias("seen"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def day_capped(items: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(one row for each title with win and, if it can't be used, status; the usable ones with whether their day's cap lets them in)."""
    rows = collapse_titles(items).withColumn("win", window_of(F.col("published"), as_of, r))
    state = F.when(~F.col("usable"), "unusable").when(is_boilerplate(F.col("title")), "boilerplate").when(F.col("win").isNull(), "outside")
    rows = rows.withColumn("status", state)
    pool = rows.where("status is null").withColumn("__day", F.row_number().over(newest(["symbol", "published"])))
    return rows, pool.withColumn("__ok", F.col("__day") <= r["sampling"]["per_day_cap"])


def window_plan(pool: DataFrame, quotas: list[int]) -> DataFrame:
    """(symbol, plan): what each window wants, gets and takes, as in ``filled``."""
    have = pool.groupBy("symbol").agg(F.array(*[F.count_if(F.col("__ok") & (F.col("win") == k)) for k in range(1, len(quotas) + 1)]).alias("have"))
    return have.select("symbol", filled(F.col("have"), quotas).alias("plan"))


def carry_log(items: DataFrame, as_of: Column, r: Rubric = DEFAULT, quotas: list[int] | None = None) -> DataFrame:
    """(symbol, win, quota, wanted, got, rolled_back): what each window wanted with the shortfall of newer ones, what it
    had, and what it gave for the shortfall that was left after the oldest. No row is sorted by window for it."""
    quotas = quotas or [q for _, _, q in r["sampling"]["windows"]]
    plan = window_plan(day_capped(items, as_of, r)[1], quotas)
    one = plan.select("symbol", F.posexplode("plan").alias("k", "p"))
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("k") + 1)
    return one.select("symbol", (F.col("k") + 1).alias("win"), quota.cast("long").alias("quota"), F.col("p.want").alias("wanted"), F.col("p.got").alias("got"), (F.col("p.take") - F.col("p.got")).alias("rolled_back"))


def stratified(items: DataFrame, as_of: Column, capped: bool = True, r: Rubric = DEFAULT, quotas: list[int] | None = None) -> DataFrame:
    """Items with win and status: selected, extra, over_budget, boilerplate, unusable or outside.

    Within a window the newest rows come first; rows past the day's cap are extras if they were looked at before the
    window was full. Without ``capped`` all usable rows are selected but the extras.
    """
    quotas = quotas or [q for _, _, q in r["sampling"]["windows"]]
    rows, pool = day_capped(items, as_of, r)
    scan = newest(["symbol", "win"]).rowsBetween(Window.unboundedPreceding, -1)
    pool = pool.withColumn("__before", F.coalesce(F.sum(F.col("__ok").cast("long")).over(scan), F.lit(0)))
    plan = window_plan(pool, quotas)
    pool = pool.join(plan, "symbol").withColumn("__p", F.element_at("plan", F.col("win")))
    picked = F.col("__ok") & (F.col("__before") < F.col("__p.take"))
    extra = ~F.col("__ok") & (F.col("__before") < F.col("__p.seen"))
    rest = "over_budget" if capped else "selected"
    pool = pool.withColumn("status", F.when(picked, "selected").when(extra, "extra").otherwise(rest))
    names = [*items.columns, "n_copies", "win", "status"]
    return pool.select(*names).unionByName(rows.where("status is not null").select(*names))


def drop_reasons(sampled: DataFrame) -> DataFrame:
    """Why a row of the sampler isn't used, null if it is or rides on a day's event as an extra source."""
    why = (
        F.when(F.col("status") == "unusable", "title does not name the company")
        .when(F.col("status") == "boilerplate", "boilerplate headline")
        .when(F.col("status") == "outside", "outside the lookback")
        .when(F.col("status") == "over_budget", "over budget")
    )
    return sampled.withColumn("reason", why)


def articles_seen(items: DataFrame, sampled: DataFrame) -> DataFrame:
    """(symbol, seq, reason) for every item that came in, in the published order of reasons: a copy of a headline that
    is used, a title that doesn't name the company, boilerplate, outside the lookback, over budget. Copies of a
    headline that isn't used have its reason. Used rows have none, and extras say that they are."""
    key = F.coalesce(F.nullif(title_key(F.col("title")), F.lit("")), F.col("url"), F.lit(""))
    told = drop_reasons(sampled).select("symbol", key.alias("__t"), F.col("seq").alias("__head"), "status", "reason")
    rows = items.select("symbol", "seq", key.alias("__t")).join(told, ["symbol", "__t"])
    used = F.col("status").isin("selected", "extra")
    why = F.when(used & (F.col("seq") != F.col("__head")), "syndicated copy").when(F.col("status") == "extra", "extra of its day").otherwise(F.col("reason"))
    return rows.select("symbol", "seq", why.alias("reason"))


def latest(items: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` titles of each symbol, those that name the company first."""
    rows = collapse_titles(items)
    w = Window.partitionBy("symbol").orderBy(F.col("usable").desc(), F.col("published").desc(), F.col("relevance").desc(), "seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def unseen(items: DataFrame, exclude: DataFrame) -> DataFrame:
    """Items whose url and title are in no excluded row, each url and title once, the newest first."""
    url, title = F.regexp_replace(url_norm(F.col("url")), "/+$", ""), title_key(F.col("title"))
    rows = items.withColumn("__u", url).withColumn("__t", title)
    gone = exclude.select("symbol", url.alias("__u"), title.alias("__t"))
    rows = rows.join(gone.select("symbol", "__u").distinct(), ["symbol", "__u"], "left_anti").join(gone.select("symbol", "__t").distinct(), ["symbol", "__t"], "left_anti")
    for key in ("__u", "__t"):
        rows = rows.withColumn("__r", F.row_number().over(newest(["symbol", key]))).where("__r = 1").drop("__r")
    return rows.drop("__u", "__t")


def governance_pass(items: DataFrame, exclude: DataFrame, as_of: Column, quotas: list[int] | None = None, r: Rubric = DEFAULT) -> DataFrame:
    """Candidates for governance: titles with one of its keywords that no excluded row has, within the quotas."""
    return governance_candidates(unseen(items.where(governance_title(F.col("title"))), exclude), as_of, quotas, r)


def unique_filings(items: DataFrame) -> DataFrame:
    """Filings of one symbol, day and first 80 characters of the title's key once, the first by seq."""
    rest = [c for c in items.columns if c not in ("symbol", "published")]
    key = F.substring(title_key(F.col("title")), 1, 80)
    out = items.withColumn("__k", key).groupBy("symbol", "published", "__k").agg(F.min_by(F.struct(*rest), "seq").alias("x"))
    return out.select("symbol", "published", "x.*").select(*items.columns)


def governance_candidates(items: DataFrame, as_of: Column, quotas: list[int] | None = None, r: Rubric = DEFAULT) -> DataFrame:
    """Rows of four windows up to quotas, with the same carries as the sampler and no day cap."""
    quotas = quotas or r["sampling"]["governance_quotas"]
    rows = items.withColumn("win", window_of(F.col("published"), as_of, r)).where("win is not null")
    rows = rows.withColumn("__k", F.row_number().over(newest(["symbol", "win"])))
    have = rows.groupBy("symbol").agg(F.array(*[F.count_if(F.col("win") == k) for k in range(1, len(quotas) + 1)]).alias("have"))
    plan = have.select("symbol", filled(F.col("have"), quotas).alias("plan"))
    return rows.join(plan, "symbol").where(F.col("__k") <= F.element_at("plan", F.col("win"))["take"]).drop("__k", "plan")


def results_buckets(items: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """At most so many rows of each 90-day bucket, newest first, and so many in all, newest buckets first."""
    s = r["sampling"]
    rows = items.withColumn("bucket", F.floor(F.datediff(as_of, "published") / s["bucket_days"]).cast("int")).where("bucket is not null")
    rows = rows.withColumn("__k", F.row_number().over(newest(["symbol", "bucket"]))).where(F.col("__k") <= s["results_per_bucket"])
    w = Window.partitionBy("symbol").orderBy("bucket", "__k")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s["results_cap"]).drop("__k")


def results_anchors(items: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """The best-sourced print of each of the newest quarters."""
    rows = items.withColumn("quarter", F.year("published") * 4 + F.quarter("published"))
    w = Window.partitionBy("symbol", "quarter").orderBy(F.col("n_sources").desc(), F.col("published").desc(), "seq")
    rows = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    w = Window.partitionBy("symbol").orderBy(F.col("quarter").desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= r["sampling"]["results_quarters"])


def scaled_quotas(budget: int, r: Rubric = DEFAULT) -> list[int]:
    """The windows' quotas for another budget: shape kept, halves to even, at least one, the rest to the newest."""
    base = [q for _, _, q in r["sampling"]["windows"]]
    out = [max(1, round(q * budget / sum(base))) for q in base]
    out[0] += budget - sum(out)
    return out


def month_histogram(items: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of each symbol in each month from start to end, empty months included."""
    months = items.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 MONTH)) AS month")
    grid = items.select("symbol").distinct().join(F.broadcast(months))
    counts = items.groupBy("symbol", F.trunc("published", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["symbol", "month"], "left").na.fill(0, ["n"])
