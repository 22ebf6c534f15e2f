"""Labels: keyword labeller, validation with reasons, price lint, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import vocabulary as v
from ..plans.rubric import DEFAULT, EVENT_TYPES, Rubric


def keyword_label(title: Column, snippet: Column, company: Column) -> Column:
    """The label struct by the first matching rule; ``other`` without one or if the company's first word is missing.

    The text is searched once: rules give a number, and all fields are looked up by it."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    rules = v.LABEL_RULES

    def rule(x: Column) -> Column:
        out = F.when(~F.contains(x, F.lower(F.substring_index(company, " ", 1))), -1)
        for k, (pattern, *_) in enumerate(rules):
            out = out.when(x.rlike(pattern), k + 1)
        return F.struct(x.alias("text"), out.otherwise(0).alias("rule"))

    def fields(f: Column) -> Column:
        k = F.greatest(f["rule"], F.lit(0))
        of = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), k)
        et, flag = of(["other", *[r[1] for r in rules]], "string"), of([False, *[r[3] for r in rules]], "boolean")
        view = F.when(F.contains(f["text"], F.lit("downgrade")), -1).when(F.contains(f["text"], F.lit("upgrade")), 1).otherwise(0)
        sentiment = F.when(et == "analyst_action", view).otherwise(of([0, *[r[2] if r[1] != "analyst_action" else 0 for r in rules]], "int"))
        named, people, none = f["rule"] >= 0, et.isin(*v.PEOPLE_TYPES), F.lit(None).cast("string")
        return F.struct(
            et.alias("event_type"),
            sentiment.cast("int").alias("sentiment"),
            flag.alias("governance_flag"),
            named.alias("about_company"),
            F.when(named, "primary").otherwise("passing").alias("substance"),
            F.when(flag, "company").otherwise(none).alias("subject"),
            F.when(flag, True).alias("occurred_at_company"),
            F.when(flag & et.isin("regulatory_action", "auditor_resignation", "auditor_restatement"), "integrity").when(flag, "material").otherwise(none).alias("severity"),
            F.when(et == "management_exit", "unplanned_exit").when(people & flag, "appointment").otherwise(none).alias("people_direction"),
            F.when(et == "management_exit", "cxo_cs_cfo_compliance").when(people & flag, "senior_management").otherwise(none).alias("role_tier"),
            F.when(~flag, none).when(et == "regulatory_action", "order_or_settlement").when(et == "investigation", "investigation").when(et == "management_change_routine", "routine").otherwise("n/a").alias("action_stage"),
        )

    found = F.transform(F.array(text), rule)
    return F.get(F.transform(found, fields), 0)


LABEL_COLUMNS = {
    "event_type": "string", "sentiment": "int", "rationale": "string", "governance_flag": "boolean", "materiality": "string", "about_company": "boolean",
    "substance": "string", "historical": "boolean", "subject": "string", "action_stage": "string", "severity": "string", "people_direction": "string",
    "role_tier": "string", "amount_inr_cr": "double",
}


def validation_reason(as_of: Column, lookback_days: int, r: Rubric = DEFAULT) -> Column:
    """The first reason to reject a labelled row, null if there is none. ``labelled`` tells whether there is a label."""
    g = r["governance"]
    url = F.trim(F.coalesce("url", F.lit("")))
    d = F.col("published")
    bad = lambda name: F.concat(F.lit(f"invalid_{name}:"), F.col(name).cast("string"))
    out = (
        F.when(url == "", "missing_source_url")
        .when(~F.lower(url).rlike("^https?://"), "invalid_source_url")
        .when(d.isNull(), "missing_or_invalid_date")
        .when(d > as_of, "date_in_future")
        .when(d < F.date_sub(as_of, lookback_days), "date_outside_lookback")
        .when(~F.col("labelled"), "no_structured_output")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), F.concat(F.lit("invalid_event_type:"), F.coalesce("event_type", F.lit("None"))))
        .when(F.col("sentiment").isNull() | ~F.col("sentiment").between(-2, 2), F.concat(F.lit("sentiment_out_of_range:"), F.coalesce(F.col("sentiment").cast("string"), F.lit("None"))))
        .when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "empty_rationale")
        .when(F.col("governance_flag").isNull(), "invalid_governance_flag")
        .when(~F.col("materiality").isin("low", "medium", "high"), bad("materiality"))
        .when(F.col("about_company") == F.lit(False), "not_about_company")
        .when(~F.col("substance").isin("primary", "passing", "boilerplate"), bad("substance"))
        .when(F.col("substance") == "boilerplate", "model_boilerplate")
    )
    for name, allowed in v.GATE_ENUMS.items():
        out = out.when(~F.col(name).isin(*allowed), bad(name))
    gated = F.col("governance_flag") & F.col("event_type").isin(*g["penalties"], *g["routine_types"])
    needs = {"subject": F.lit(True), "severity": F.lit(True), "people_direction": F.col("event_type").isin(*v.PEOPLE_TYPES), "role_tier": F.col("event_type").isin(*v.PEOPLE_TYPES), "action_stage": F.col("event_type").isin(*v.STAGED_TYPES)}
    for name, when in needs.items():
        out = out.when(gated & when & F.col(name).isNull(), f"incomplete_governance_verification:{name}")
    return out


def validated(labelled: DataFrame, as_of: Column, lookback_days: int, r: Rubric = DEFAULT) -> DataFrame:
    """Adds reason; rows to keep have none, and the others are the reject stream of the same plan."""
    for name, kind in LABEL_COLUMNS.items():
        if name not in labelled.columns:
            labelled = labelled.withColumn(name, F.lit(None).cast(kind))
    return labelled.withColumn("reason", validation_reason(as_of, lookback_days, r))


def price_lint(labelled: DataFrame) -> DataFrame:
    """Rows that are only about the share price become price moves, which feed nothing."""
    hit = tx.price_only(F.col("title"))
    return labelled.withColumns(
        {
            "price_only": hit,
            "event_type": F.when(hit, "price_move").otherwise(F.col("event_type")),
            "sentiment": F.when(hit, 0).otherwise(F.col("sentiment")),
            "governance_flag": F.when(hit, False).otherwise(F.col("governance_flag")),
        }
    )


def headline_copy(rationale: Column, title: Column) -> Column:
    """Whether a rationale only repeats the headline."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    a, b = words(rationale), words(title)
    return (F.coalesce(rationale, F.lit("")) == "") | ((F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) >= 0.75))


def from_cache(items: DataFrame, cache: DataFrame, index: DataFrame) -> DataFrame:
    """Adds label and source: the cache by item key, else the stored index by url hash, else by a member's hash."""
    hit = items.join(cache.select("item_key", F.col("label").alias("__a")), "item_key", "left")
    stored = index.select("url_hash", F.col("label").alias("__b"))
    hit = hit.join(stored, "url_hash", "left")
    member = items.select("seq", F.explode("member_hashes").alias("url_hash")).join(stored, "url_hash").groupBy("seq").agg(F.min_by("__b", "url_hash").alias("__c"))
    hit = hit.join(member, "seq", "left")
    source = F.when(F.col("__a").isNotNull(), "cache").when(F.col("__b").isNotNull(), "corpus").when(F.col("__c").isNotNull(), "member").otherwise("label")
    return hit.withColumn("label", F.coalesce("__a", "__b", "__c")).withColumn("label_source", source).drop("__a", "__b", "__c")


def pending(items: DataFrame, *known: DataFrame) -> DataFrame:
    """Items whose key is in none of the tables: those that still need a label."""
    for k in known:
        items = items.join(k.select("item_key").distinct(), "item_key", "left_anti")
    return items
