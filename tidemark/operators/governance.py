"""Governance: the verification gate, events counted once, the score."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import event_words
from ..functions.timing import age_factor
from ..plans import vocabulary as v
from ..plans.rubric import DEFAULT, Rubric
from .grouped import over_groups

GATE_COLUMNS = {
    "title": "string", "rationale": "string", "event_type": "string", "materiality": "string", "subject": "string",
    "occurred_at_company": "boolean", "action_stage": "string", "severity": "string", "amount_inr_cr": "double",
    "people_direction": "string", "role_tier": "string", "penalty_override": "double", "historical": "boolean",
    "event_key": "string", "confidence": "double", "max_tier": "string",
}


def with_gate_columns(rows: DataFrame) -> DataFrame:
    """Adds the gate's columns that are missing, as nulls."""
    for name, kind in GATE_COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def lookup(key: Column, values: dict) -> Column:
    out = None
    for k, x in values.items():
        out = F.when(key == k, F.lit(x)) if out is None else out.when(key == k, F.lit(x))
    return out


def base_penalty(r: Rubric = DEFAULT) -> Column:
    """The type's penalty, by materiality (medium without one) where it has several; null for other types."""
    et, flat = F.col("event_type"), {}
    out = None
    for k, p in r["governance"]["penalties"].items():
        if isinstance(p, dict):
            mat = F.coalesce("materiality", F.lit("medium"))
            value = F.when(mat == "low", float(p["low"])).when(mat == "high", float(p["high"])).otherwise(float(p["medium"]))
            out = F.when(et == k, value) if out is None else out.when(et == k, value)
        else:
            flat[k] = float(p)
    for k, p in flat.items():
        out = out.when(et == k, F.lit(p))
    return out


def people_override() -> Column:
    """Why a management exit is none, read off its text; null if it may be one."""
    title = F.coalesce("title", F.lit(""))
    text = F.concat(title, F.lit(". "), F.coalesce("rationale", F.lit("")))
    has = lambda c, p: c.rlike("(?i)" + p)
    return (
        F.when(F.col("event_type") != "management_exit", F.lit(None).cast("string"))
        .when(has(title, v.BENIGN_PEOPLE) & ~has(title, v.EXIT_WORDS), "elevation or planned change")
        .when(has(text, v.RETIRED) & ~has(title, v.NOT_RETIRED), "planned retirement")
        .when(has(text, v.ORDERLY) & ~has(title, v.ABRUPT), "orderly succession")
        .when(~has(text, v.C_SUITE), "below the top tier")
    )


def gate(rows: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Adds bucket (override, routine, subject, people, resolved or penalty) and penalty (null unless penalised).

    The rules are one ordered CASE: subject, place, victim and macro texts, people, stage, then the caps.
    """
    g = r["governance"]
    rows = with_gate_columns(rows)
    et, title, stage, sev = F.col("event_type"), F.coalesce("title", F.lit("")), F.col("action_stage"), F.col("severity")
    rows = rows.withColumn("__base", base_penalty(r))
    base, subject = F.col("__base"), F.col("subject")
    given = subject.isNotNull() & (subject != "")
    has = lambda p: title.rlike("(?i)" + p)
    tier = F.col("role_tier")
    bucket = (
        F.when(F.col("penalty_override").isNotNull(), "override")
        .when(base.isNull(), "routine")
        .when(given & ~subject.isin(*g["subject_ok"]), "subject")
        .when((F.col("occurred_at_company") == F.lit(False)) & ~F.coalesce(subject.isin("promoter_or_insider", "subsidiary"), F.lit(False)), "subject")
        .when(et.isin("regulatory_action", "investigation", "exchange_fine") & has(v.VICTIM), "subject")
        .when((et == "regulatory_action") & has(v.MACRO) & ~has(v.NAMED_ORDER), "subject")
        .when(people_override().isNotNull(), "people")
        .when((et == "management_exit") & F.col("people_direction").isin(*g["people_never_an_exit"]), "people")
        .when((et == "management_exit") & tier.isNotNull() & (tier != "") & (tier != g["exit_requires_role_tier"]), "people")
        .when(stage == "resolved_or_quashed", "resolved")
        .when((stage == "routine") & (et != "management_exit"), "routine")
        .otherwise("penalty")
    )
    capped = ~et.isin(*g["severity_caps_exempt_types"])
    small = capped & ~F.coalesce(sev.isin(*g["floor_exempt_severities"]), F.lit(False)) & (F.col("amount_inr_cr") < g["materiality_floor_cr"])
    caps = [
        F.when((et == "regulatory_action") & (stage == "notice_or_demand"), F.lit(float(g["notice_without_order_penalty"]))),
        *[F.when(capped & (sev == name), F.lit(float(cap))) for name, cap in g["severity_caps"].items()],
        F.when(small, F.lit(float(g["procedural_band_penalty"]))),
    ]
    p = F.greatest(F.col("__base"), *caps)  # the mildest of the base and the caps that apply
    out = rows.withColumn("bucket", bucket)
    # as a generator's output, so that filters on it don't carry copies of the rules below
    penalty = F.when(F.col("bucket") == "override", F.col("penalty_override")).when(F.col("bucket") == "penalty", p)
    return out.select("*", F.explode(F.array(penalty)).alias("penalty")).drop("__base")


def family(et: Column, r: Rubric = DEFAULT) -> Column:
    return F.coalesce(lookup(et, r["governance"]["families"]), et)


#: Parts a symbol from a date where scores of many dates are made at once.
AT = "\x1f"
SAME_EVENT = "symbol string, seq long, dup_of long"


def company_words(rows: DataFrame) -> Column:
    """The words by which a title names its own company: the symbol and, where rows have it, the company's name."""
    symbol = F.array(F.lower(F.substring_index("symbol", AT, 1)))
    if "company" not in rows.columns:
        return symbol
    return F.array_union(symbol, F.regexp_extract_all(F.lower(F.coalesce("company", F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def same_events(candidates: DataFrame, own_words: Column | None = None, r: Rubric = DEFAULT) -> DataFrame:
    """(symbol, seq, dup_of): candidates that tell of an event that a more severe candidate tells of.

    Greedy, most severe first, against the rows kept so far, so it is no closure that a join could give. Rows can only
    meet within a family, so a group is a symbol's candidates of one family: flagged rows that passed the gate. The
    company's own words (``company_words``, or those given) say nothing of an event and are left out.
    """
    days = r["governance"]["dedupe_days"]
    own = own_words if own_words is not None else company_words(candidates)
    rows = candidates.select(
        "symbol", "seq", "published", "penalty", family(F.col("event_type"), r).alias("family"),
        F.regexp_replace(F.lower(F.coalesce("event_key", F.lit(""))), "[^a-z0-9]", "").alias("k"),
        event_words(F.col("title"), F.col("event_key"), own).alias("words"),
    ).where("published is not null")

    def greedy(group: Iterator[tuple]) -> list[tuple]:
        kept: dict[int, list[tuple]] = defaultdict(list)  # by block of days, so a row looks only at those in its reach
        out = []
        for n, (symbol, seq, day, _, _, key, words) in enumerate(group):
            words, block = frozenset(words), day.toordinal() // (days + 1)
            first = None
            for near in (block - 1, block, block + 1):
                for order, kept_seq, kept_day, kept_key, kept_words in kept[near]:
                    if first and order > first[0]:
                        break
                    gap = abs((day - kept_day).days)
                    if gap > days:
                        continue
                    shared = len(words & kept_words)
                    if (key and key == kept_key) or (shared >= 2 and (shared / max(min(len(words), len(kept_words)), 1) >= 0.5 or gap <= 3)):
                        first = (order, kept_seq)
                        break
            if first:
                out.append((symbol, seq, first[1]))
            else:
                kept[block].append((n, seq, day, key, words))
        return out

    return over_groups(rows, ["symbol", "family"], ["penalty", "published", "seq"], greedy, SAME_EVENT)


def once_per_type(candidates: DataFrame, as_of: Column, r: Rubric = DEFAULT) -> DataFrame:
    """Adds eff (the penalty faded by age) and keeps, for each symbol and type, human-set rows and the row with the
    largest faded penalty, the newest of equal ones."""
    faded = F.bround(F.col("penalty") * age_factor(F.col("published"), as_of, r)).cast("double")
    human = F.col("penalty_override").isNotNull()
    rows = candidates.withColumn("eff", F.when(human, F.col("penalty")).otherwise(faded))
    w = Window.partitionBy("symbol", "event_type").orderBy(human.desc(), F.col("eff"), F.col("published").desc(), F.col("seq"))
    return rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") == 1) | human).drop("rank")


def label_of(score: Column, r: Rubric = DEFAULT) -> Column:
    out = None
    for name, least in r["governance"]["labels"]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out


def penalties(flagged: DataFrame, as_of: Column, r: Rubric = DEFAULT, dedupe: bool = True, own_words: Column | None = None) -> DataFrame:
    """The in-window penalties that count: gated, one for each real event, once for each type, faded."""
    gated = gate(flagged.where("governance_flag"), r).where("penalty is not null")
    live = gated.where(~F.coalesce("historical", F.lit(False)) | F.col("penalty_override").isNotNull())
    if dedupe:
        live = live.join(same_events(live, own_words, r).select("symbol", "seq"), ["symbol", "seq"], "left_anti")
    return once_per_type(live, as_of, r)


def governance(flagged: DataFrame, holdings: DataFrame, as_of: Column, r: Rubric = DEFAULT, dedupe: bool = True) -> DataFrame:
    """(symbol, penalty_sum, n_penalties, memory_discount, governance_score, governance_label) for each holding."""
    g = r["governance"]
    applied = penalties(flagged, as_of, r, dedupe)
    sums = applied.groupBy("symbol").agg(F.sum("eff").alias("penalty_sum"), F.count(F.lit(1)).alias("n_penalties"), F.count_if(F.col("event_type") != "mnc_structural_discount").alias("n_real"))
    past = gate(flagged.where("governance_flag and historical and penalty_override is null") if "penalty_override" in flagged.columns else flagged.where("governance_flag and historical"), r).where("penalty is not null")
    past = past.join(applied.select("symbol", "event_type").distinct(), ["symbol", "event_type"], "left_anti")
    memory = past.groupBy("symbol").agg(F.max_by("event_type", F.struct("published", "seq")).alias("memory_type"))
    out = holdings.select("symbol").distinct().join(sums, "symbol", "left").join(memory, "symbol", "left")
    only = (F.coalesce("n_real", F.lit(0)) == 0) if g["memory_discount_only_if_no_in_window_penalty"] else F.lit(True)
    discount = F.when(F.col("memory_type").isNotNull() & only, float(g["historical_penalty"])).otherwise(0.0)
    out = out.select("symbol", F.coalesce("penalty_sum", F.lit(0.0)).alias("penalty_sum"), F.coalesce("n_penalties", F.lit(0)).cast("long").alias("n_penalties"), discount.alias("memory_discount"))
    score = F.lit(float(g["start"])) + F.col("penalty_sum") + F.col("memory_discount")
    return out.withColumn("governance_score", score).withColumn("governance_label", label_of(F.col("governance_score"), r))


def running_scores(applied: DataFrame, r: Rubric = DEFAULT) -> DataFrame:
    """Each counted penalty with the score after it, most severe first."""
    w = Window.partitionBy("symbol").orderBy("eff", "published", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return applied.select("symbol", "seq", "event_type", "eff", (F.lit(float(r["governance"]["start"])) + F.sum("eff").over(w)).alias("running"))
