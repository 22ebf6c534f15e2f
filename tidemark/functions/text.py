"""Column functions over titles and urls: keys, tokens, similarities, styles, tiers, price language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rubric import DEFAULT, Rubric
from ..plans.vocabulary import (
    BOILERPLATE,
    CLUSTER_STOP,
    DOMAIN_TIERS,
    EVENT_STOP,
    FILING_DOMAINS,
    FUNDAMENTAL,
    FUND_TITLE,
    GOV_TITLE,
    PRESS_DOMAINS,
    PRICE_LANGUAGE,
    PR_DOMAINS,
    STYLES,
)


def either(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")


def url_norm(url: Column) -> Column:
    return F.lower(F.trim(F.coalesce(url, F.lit(""))))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(url_norm(url), "/+$", ""), 256), 1, 16)


def item_key(url: Column, title: Column, snippet: Column, model: Column, prompt_version: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, snippet, model, prompt_version)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def event_id(symbol: Column, event_date: Column, hashes: Column) -> Column:
    return F.substring(F.sha1(F.concat(symbol, F.lit("|"), event_date.cast("string"), F.lit("|"), F.array_join(hashes, ","))), 1, 12)


def tokens(title: Column, own: Column | None = None) -> Column:
    """Distinct words of three characters or more, without stop words, short numbers and the company's own words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]+", " ")), " +")
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~((F.length(w) < 4) & w.rlike("^[0-9]+$"))))
    kept = F.array_except(kept, F.array(*[F.lit(w) for w in CLUSTER_STOP]))
    return kept if own is None else F.array_except(kept, own)


def event_words(title: Column, event_key: Column, own: Column) -> Column:
    """Words of four characters or more of a title and an event key, without stop words and the company's own."""
    found = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0))
    both = F.array_union(found(title), found(F.replace(F.coalesce(event_key, F.lit("")), F.lit("-"), F.lit(" "))))
    return F.array_except(F.array_except(both, own), F.array(*[F.lit(w) for w in EVENT_STOP]))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def numbers(title: Column) -> Column:
    """The figures of a title, in order; without any, the first six of its sorted long words."""
    t = F.coalesce(title, F.lit(""))
    figures = F.array_sort(F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    words = F.slice(F.array_sort(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{4,}"), F.lit(0))), 1, 6)
    return F.when(F.size(figures) > 0, figures).otherwise(words)


def title_hit(title: Column, name_tokens: Column) -> Column:
    return F.exists(name_tokens, lambda t: F.contains(F.lower(F.coalesce(title, F.lit(""))), t))


def is_boilerplate(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(either(BOILERPLATE))


def governance_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)" + GOV_TITLE)


def results_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike("(?i)" + FUND_TITLE)


def price_only(title: Column) -> Column:
    """About the share price and nothing that moves the business."""
    t = F.coalesce(title, F.lit(""))
    return t.rlike(either(PRICE_LANGUAGE)) & ~t.rlike("(?i)" + FUNDAMENTAL)


def strip_price_sentences(text: Column) -> Column:
    """A paragraph without sentences that reason from the share price, but for those marked [context]."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: F.contains(s, F.lit("[context]")) | ~s.rlike(either(PRICE_LANGUAGE)))
    return F.trim(F.replace(F.array_join(kept, " "), F.lit("[context]"), F.lit("")))


#: Words of the engine's own workings, which no commentary should hold.
HIDDEN = ("quarantin", "gate b")


def scrubbed(text: Column, most: int | None = None) -> Column:
    """Commentary without sentences about the engine's workings and without dashes as clause breaks, which become
    commas, its paragraphs kept; with ``most`` cut to whole sentences of so many words."""
    hidden = lambda s: F.lower(s).rlike("|".join(HIDDEN))
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.array_join(F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: ~hidden(s)), " "))
    out = F.regexp_replace(F.array_join(F.filter(clean, lambda p: p != ""), "\n\n"), r"\s*[–—]\s*|\s+-\s+", ", ")
    return out if most is None else F.when(F.size(F.split(F.trim(out), r"\s+")) <= most, out).otherwise(cap_words(out, most))


def reply_objects(reply: Column) -> Column:
    """The flat JSON objects with an id in a model's reply, as strings, whatever stands around them: fences, prose, a
    wrapping object, stray brackets or an array that breaks off."""
    found = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.filter(found, lambda o: F.try_parse_json(o).isNotNull() & F.get_json_object(o, "$.id").isNotNull())


def cap_words(text: Column, most: int) -> Column:
    """The first whole sentences that together have ``most`` words at most; a first one that is longer stays whole."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    count = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("s"), F.lit(True).alias("on"))
    return F.array_join(
        F.aggregate(
            sentences,
            start,
            lambda a, x: F.struct(
                (a["n"] + count(x)).alias("n"),
                F.when(a["on"] & ((a["n"] == 0) | (a["n"] + count(x) <= most)), F.concat(a["s"], F.array(x))).otherwise(a["s"]).alias("s"),
                (a["on"] & ((a["n"] == 0) | (a["n"] + count(x) <= most))).alias("on"),
            ),
            lambda a: a["s"],
        ),
        " ",
    )


def domain_of(url: Column, source: Column) -> Column:
    """The publisher: the source if it looks like a host, else the url's host; news aggregators give way to the source."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    hosted = F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(" "))
    return F.when(hosted, F.regexp_replace(s, r"^www\.", "")).when(host.isin("news.google.com", ""), F.when(s != "", s).otherwise(host)).otherwise(host)


def tier_of(domain: Column) -> Column:
    """The tier of the longest suffix of two labels or more that has one; T3 without."""
    known = F.create_map(*[F.lit(x) for pair in DOMAIN_TIERS.items() for x in pair])
    labels = F.split(F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hits = F.filter(F.transform(suffixes, lambda x: F.try_element_at(known, x)), lambda t: t.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit("T3"))


def tier_weight(tier: Column, r: Rubric = DEFAULT) -> Column:
    out = F.lit(float(r["tier_weight"]["T3"]))
    for t, w in r["tier_weight"].items():
        out = F.when(tier == t, F.lit(float(w))).otherwise(out)
    return out


def confidence(n_sources: Column, max_tier: Column, r: Rubric = DEFAULT) -> Column:
    """Before rounding to three places for display."""
    c = r["cluster"]
    return F.least(F.lit(1.0), F.lit(c["base"]) + F.lit(c["slope"]) * F.log(F.lit(1.0) + F.greatest(n_sources, F.lit(0)))) * tier_weight(max_tier, r)


def style(kind: Column, title: Column, snippet: Column, domain: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    ends = lambda names: domain.rlike("(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    out = F.when(kind == "action", "corporate-action").when(ends(FILING_DOMAINS), "exchange-filing").when(ends(PR_DOMAINS), "press-release")
    for name, pattern in STYLES:
        out = out.when(t.rlike(pattern), name)
    return out.when(ends(PRESS_DOMAINS), "business-news").otherwise("general-news")


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
