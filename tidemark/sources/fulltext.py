"""Article text from stored pages: structured bodies first, then paragraphs, then the description."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .connectors import open_with

#: Fixed value: what marks a paragraph as no part of the article.
JUNK = (
    r"(?i)cookie|subscribe|sign up|log ?in\b|newsletter|download (the )?app|advertisement|all rights reserved|follow us|"
    r"outdated browser|get notified|whatsapp|telegram|-->|›"
)
#: Fixed value: the parts of a page that are no text.
ASIDE = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ENTITY = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)"
#: Characters by name, from the language's own table.
NAMED = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'"}
#: What numbers of C1 controls mean in pages.
WINDOWS = {k: bytes([k]).decode("cp1252") for k in range(128, 160) if k not in (129, 141, 143, 144, 157)}
SCRIPT = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
ABOUT = (
    r"""(?is)<meta[^>]+(?:property="og:description"|name="description")[^>]+content="([^"]+)\"""",
    r"""(?is)<meta[^>]+content="([^"]+)"[^>]+(?:property="og:description"|name="description")""",
)
LINKED = "array<struct<articleBody:string,`@graph`:array<struct<articleBody:string>>>>"


def table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def decoded(text: Column) -> Column:
    """Entities as the characters that they stand for; unknown ones stay."""

    def value(e: Column) -> Column:
        body = F.regexp_replace(e, "^&#?|;$", "")
        number = F.when(body.rlike("^[xX]"), F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        bad = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        told = F.when(bad, "\ufffd").when(number.between(128, 159), F.coalesce(F.element_at(table(WINDOWS), number), F.lit(""))).otherwise(char)
        return F.coalesce(F.when(F.startswith(e, F.lit("&#")), told).otherwise(F.element_at(table(NAMED), body)), e)

    found = F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), value))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(found, F.split(text, ENTITY), lambda v, p: F.concat(v, p)), "")).otherwise(text)


def plain(html: Column) -> Column:
    """Without tags, entities decoded, white space in single spaces."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, "<[^>]+>", " ")), SPACE, " "))


def structured(page: Column) -> Column:
    """The first articleBody of more than 200 characters in the page's JSON-LD scripts; those that aren't JSON are
    passed over."""

    def bodies(script: Column) -> Column:
        text = F.trim(F.regexp_replace(script, f"^{SPACE}|{SPACE}$", ""))
        listed = F.startswith(text, F.lit("["))
        found = F.filter(F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), LINKED), lambda o: o.isNotNull())
        each = F.transform(found, lambda o: F.when(listed | o["@graph"].isNull(), F.array(o["articleBody"])).otherwise(F.transform(o["@graph"], lambda g: g["articleBody"])))
        return F.coalesce(F.flatten(each), F.expr("cast(array() as array<string>)"))

    every = F.flatten(F.transform(F.regexp_extract_all(page, F.lit(SCRIPT), F.lit(1)), bodies))
    return F.get(F.filter(every, lambda b: F.length(b) > 200), 0)


def extract(html: Column, limit: int = 4000) -> Column:
    """The article's text, best source first: a structured articleBody of more than 200 characters; else paragraphs
    outside menus, scripts and forms, of more than 70 characters and without words that mark them as no part of it, if
    they make more than 250, led by a description of more than 80; else that description; else nothing."""
    page = F.coalesce(html, F.lit(""))
    body = F.when(F.contains(page, F.lit("ld+json")), structured(page))
    found = [F.regexp_extract(page, p, 1) for p in ABOUT]
    about = plain(F.coalesce(F.nullif(found[0], F.lit("")), found[1]))
    rest = F.regexp_replace(page, rf"(?is)<({'|'.join(ASIDE)})[^>]*>.*?</\1>", " ")
    # computed once for the row, though it is read several times
    parts = F.array(F.struct(about.alias("about"), F.transform(F.regexp_extract_all(rest, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), plain).alias("p")))

    def best(x: Column) -> Column:
        kept = F.filter(x["p"], lambda p: (F.length(p) > 70) & ~p.rlike(JUNK) & (p != x["about"]))
        lead = F.when(F.length(x["about"]) > 80, x["about"])
        many = F.aggregate(kept, F.lit(0), lambda a, p: a + F.length(p)) > 250
        return F.when(many, F.concat(F.coalesce(F.concat(lead, F.lit(" ")), F.lit("")), F.substring(F.array_join(kept, " "), 1, limit))).otherwise(F.coalesce(F.substring(lead, 1, limit), F.lit("")))

    return F.coalesce(F.substring(plain(body), 1, limit), F.get(F.transform(parts, best), 0))


def fetched(items: DataFrame, opener: str, workers: int = 16) -> DataFrame:
    """Items with html, the page at their url, null where it can't be had. Each task fetches a batch's pages with a few
    threads; a page that fails is no error of the task. There is no time budget, so a run can be repeated."""
    names = items.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = open_with(opener)

        def page(url: str | None) -> str | None:
            try:
                return get(url) if url else None
            except Exception:  # whatever a page does, the others go on
                return None

        with ThreadPoolExecutor(workers) as pool:
            for batch in it:
                html = list(pool.map(page, batch.column(batch.schema.get_field_index("url")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(html, pa.string())], [*names, "html"])

    return items.mapInArrow(run, f"{kinds}, html string")
