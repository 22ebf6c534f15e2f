"""Operator 8: personal data, by fixed patterns and by bootstrapped contexts, with DataFrame operations only.

The fixed patterns give the base spans. Places come from splitting a text at a pattern: the lengths of the parts
and of the matches add up to them. The patterns are written so that Java's matcher neither recurses nor starts
over within a run of characters (possessive repeats, starts only where a run starts or where the last match ended);
they match what the plain ones match.

Bootstrapping: every base span, and every other token with a digit or an at sign, is an instance. Seeds are the base
spans and, of kind ``secret``, tokens of ``LEAST_SECRET`` characters or more, letters and digits, that a word of
``SECRET_KEYS`` and an equals sign or colon stand before. A place of an instance induces up to four lexical patterns: the
two words before it, the words before and after it, the word before it with the token's shape, and the key before an
equals sign or colon. Each also says whether the token has an at sign, is a number or mixes letters and digits.

Pairs of pattern and instance make a bipartite graph, which holds each pair once, so a word before many copies of a
number counts once. A value that can't be an identifier (few digits and no at sign, or the form of a card or address that fails its check) is a counterexample; one that could be
and isn't known to be is neither for nor against a pattern. In each round a pattern's support is its instances' summed
confidence and its trust that over support, counterexamples and ``DOUBT``. It is trusted from ``TRUST`` if it stands
before ``LEAST_SEEDS`` different seeds at least and its support's share of the values that could be identifiers, times the
support's logarithm to base 2, reaches ``LEAST_WORTH``: half of ten values are enough, and 16 of 64, but not three of a
thousand. An instance's
confidence is one less the product of its trusted patterns' doubts; seeds stay at one. Confidences only rise, and the
rounds end when none rises by more than ``SETTLED``. Then instances that reach ``SURE`` and have ``LEAST_DIGITS`` digits,
or mix letters with two digits in ``LEAST_MIXED`` characters, or join two words by an at sign are spans of kind
``context`` where a trusted pattern holds, or anywhere if they are seeds elsewhere, and no base span is. Spans of kind ``secret`` stand before them.

Base spans and tokens of a text are laid out in one order of place by a window over the text, after its repeated rows
are made one, so a long text costs little more than its length.

Defined cases: a null text is an empty one; rows equal in doc_id and text have equal spans; a null doc_id is a row
like others; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with runs that are never entered again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+"
#: The words that make what an equals sign or colon parts from them a secret.
SECRET_KEYS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "auth", "bearer", "credential")
LEAST_SEEDS, DOUBT, TRUST, LEAST_WORTH, SURE, SETTLED = 3, 0.5, 0.7, 1.0, 0.75, 1e-3
LEAST_DIGITS, LEAST_MIXED, LEAST_SECRET = 6, 8, 16
KEYED = r"^[^A-Za-z0-9]*[A-Za-z][A-Za-z0-9_.-]*[\"']?[:=]+[\"']?(?=[A-Za-z0-9+])"
BLOCK = 200
SPAN = "array<struct<s:int,e:int,v:string>>"


def placed(parts: Column, found: Column) -> Column:
    """(start, end, value) of each match, in code points, from the parts that the text splits into at the matches.

    Lengths are summed up in blocks of ``BLOCK`` matches, so that a text of many matches costs little more than its
    length."""
    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("n"), m.alias("m")))
    none = F.expr(f"cast(array() as {SPAN})")

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["p"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["p"]).alias("s"), (a["at"] + x["p"] + x["n"]).alias("e"), x["m"].alias("v")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["p"] + x["n"]))
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    many = F.flatten(F.zip_with(blocks, starts, within))
    return F.when(F.size(found) == 0, none).when(F.size(found) <= BLOCK, within(pairs, F.lit(0))).otherwise(many)


def luhn(m: Column) -> Column:
    digits = F.split(F.reverse(F.translate(m, " -", "")), "")
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        n = F.length(F.translate(m, " -", ""))
        return F.when(n.between(16, 19), luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def valid_spans(kind: str) -> Column:
    return F.filter(placed(F.col(f"p_{kind}"), F.col(f"m_{kind}")), lambda x: valid(kind, x["v"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, __key, a column of spans for each kind, and the candidate tokens with their left
    contexts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__key", F.xxhash64("doc_id", "text"))
    # only a text with a digit or an at sign is split
    some, at = F.col("text").rlike("[0-9@]"), F.contains("text", F.lit("@"))
    none = F.array(F.lit(""))
    guard = {"email": at, "ip": some, "card": some, "phone": F.contains("text", F.lit("+"))}
    parts = [F.when(guard[k], F.split("text", PATTERNS[k])).otherwise(none).alias(f"p_{k}") for k in KINDS]
    rows = rows.select("doc_id", "__key", "text", *parts, F.when(some, F.split("text", TOKEN)).otherwise(none).alias("p_token"))

    def found(name: str, pattern: str) -> Column:
        return F.when(F.size(f"p_{name}") > 1, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias(f"m_{name}")

    rows = rows.select("*", *[found(k, PATTERNS[k]) for k in KINDS], found("token", TOKEN))
    spans = [valid_spans(k).alias(k) for k in KINDS]
    left = F.transform("p_token", lambda p: F.lower(F.regexp_extract(p, r"([^\x20\x09-\x0D]*[\x20\x09-\x0D]*[^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1)))
    right = F.transform("p_token", lambda p: F.lower(F.regexp_extract(p, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)))
    about = F.zip_with(F.slice(left, 1, F.size("m_token")), F.slice(right, 2, F.size("m_token")), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    tokens = F.zip_with(placed(F.col("p_token"), F.col("m_token")), about, lambda x, c: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), c["left"].alias("left"), c["right"].alias("right")))
    return rows.select("doc_id", "__key", *spans, tokens.alias("tokens"))


def core(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"^[^A-Za-z0-9+@]+", ""), r"[^A-Za-z0-9]+$", "")


def instances(found: DataFrame) -> DataFrame:
    """From base spans and tokens, (__key, s, e, v, left, right, seed): base spans that start a token as seeds, and
    the tokens that no base span starts or goes on in."""
    token = "struct<s:int,e:int,v:string,left:string,right:string,base:boolean>"
    every = F.transform(F.concat(*KINDS), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit("").alias("left"), F.lit("").alias("right"), F.lit(True).alias("base")))
    words = F.transform("tokens", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v"), t["left"].alias("left"), t["right"].alias("right"), F.lit(False).alias("base")))
    laid = F.concat(words.cast(f"array<{token}>"), every.cast(f"array<{token}>"))
    once = found.where(F.size("tokens") > 0).select("__key", laid.alias("all")).groupBy("__key").agg(F.first("all").alias("all"))
    rows = once.select("__key", F.inline("all"))
    order = Window.partitionBy("__key").orderBy("s", "base", "e")
    reach = F.max(F.when(F.col("base"), F.col("e")))
    rows = rows.select(
        "*",
        F.coalesce(reach.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("reach"),
        F.coalesce(reach.over(order.rowsBetween(Window.unboundedPreceding, -2)), F.lit(-1)).alias("reach_before"),
        F.lag(F.struct("s", "e", "left", "right", "base")).over(order).alias("before"),
        F.lead(F.struct("s", "base")).over(order).alias("after"),
    )
    # a base span stands for the token that it starts in; tokens that one goes on in are no instances
    starts = F.col("base") & ~F.col("before.base") & (F.col("s") < F.col("before.e")) & (F.col("reach_before") <= F.col("before.s"))
    own = ~F.col("base") & (F.col("reach") <= F.col("s")) & ~F.coalesce(F.col("after.base") & (F.col("after.s") < F.col("e")), F.lit(False))
    side = lambda c: F.when(F.col("base"), F.col(f"before.{c}")).otherwise(F.col(c)).alias(c)
    return rows.where(F.coalesce(starts, F.lit(False)) | own).select("__key", "s", "e", "v", side("left"), side("right"), F.col("base").alias("seed"))


def described(rows: DataFrame) -> DataFrame:
    """Adds to instances the value without marks at its ends, its place, its patterns and whether it is a secret."""
    # key=value in one token: the key belongs to the words before it
    inside = F.when(F.col("seed"), F.lit("")).otherwise(F.regexp_extract("v", KEYED, 0))
    rows = rows.withColumn("inside", inside)
    rows = rows.withColumn("left", F.when(F.col("inside") != "", F.lower("inside")).otherwise(F.regexp_replace("left", r"[\x20\x09-\x0D]+", " ")))
    rest = F.substr("v", F.length("inside") + 1)
    lead = F.length(rest) - F.length(F.regexp_replace(rest, r"^[^A-Za-z0-9+@]+", ""))
    rows = rows.withColumn("instance", F.when(F.col("seed"), F.col("v")).otherwise(core(rest)))
    rows = rows.withColumn("s", F.when(F.col("seed"), F.col("s")).otherwise(F.col("s") + F.length("inside") + lead))
    rows = rows.where("instance <> ''").withColumn("e", F.when(F.col("seed"), F.col("e")).otherwise(F.col("s") + F.length("instance")))
    value = F.lower("instance")  # copies in capitals are one instance
    key = F.regexp_extract("left", r"([a-z0-9_.-]+)[\"']?\s?[:=]+[\"']?$", 1)
    digits = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    sort = F.when(F.contains("instance", F.lit("@")), "@").when(F.col("instance").rlike("[A-Za-z]"), "a").otherwise("0")
    long = F.col("instance").rlike(rf"^[A-Za-z0-9+/_=.-]{{{LEAST_SECRET},}}$") & F.col("instance").rlike("[A-Za-z]") & (digits >= 2)
    word = F.regexp_extract("left", r"([^ ]+)$", 1)
    shape = F.when(sort == "0", F.regexp_replace(value, "[0-9]", "9")).otherwise(F.concat(sort, F.length("instance").cast("string")))
    patterns = F.array(
        F.when(F.contains("left", F.lit(" ")) | (F.col("inside") != ""), F.concat(F.lit("2 "), "left", F.lit(" "), sort)),
        F.when((word != "") & (F.col("right") != ""), F.concat(F.lit("m "), word, F.lit(" _ "), "right", F.lit(" "), sort)),
        F.when(word != "", F.concat(F.lit("s "), word, F.lit(" "), shape)),
        F.when(key != "", F.concat(F.lit("k "), key, F.lit(" "), sort)),
    )
    secret = ~F.col("seed") & key.isin(*SECRET_KEYS) & long
    told = (digits >= LEAST_DIGITS) | F.col("instance").rlike("[A-Za-z0-9]@[A-Za-z0-9]") | ((F.length("instance") >= LEAST_MIXED) & F.col("instance").rlike("[A-Za-z]") & (digits >= 2))
    refuted = lambda kind, form: F.when(F.col("instance").rlike(form), ~valid(kind, F.col("instance"))).otherwise(False)
    told = told & ~refuted("card", r"^[0-9](?:[\x20-]?[0-9]){15,18}$") & ~refuted("ip", r"^[0-9]+(?:\.[0-9]+){3}$")
    return rows.select("__key", "s", "e", value.alias("instance"), F.array_compact(patterns).alias("patterns"), F.col("seed").alias("base"), secret.alias("secret"), told.alias("told"))


def scored(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of edges (pattern, instance, seed, told): trusted patterns (pattern, trust) and instances (instance, score)."""
    # a value that is a seed anywhere is one everywhere
    scores = scratch.save(edges.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("seed").cast("double").alias("score")))
    trusted = None
    while True:
        known = edges.select("pattern", "instance", "told").join(scores, "instance")
        able = F.col("told") | F.col("seed")
        new = known.groupBy("pattern").agg(F.round(F.sum("score"), 9).alias("support"), F.count_if(able).alias("n"), F.count_if(~able).alias("against"), F.count_if("seed").alias("seeds"))
        new = new.withColumn("trust", F.round(F.col("support") / (F.col("support") + F.col("against") + DOUBT), 9))
        worth = F.col("support") / F.col("n") * F.log2(F.greatest("support", F.lit(1.0)))
        new = scratch.save(new.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("trust") >= TRUST) & (worth >= LEAST_WORTH)).select("pattern", "trust"))
        doubts = edges.join(new, "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.least("trust", F.lit(1 - 1e-9)))).alias("doubt"))
        told = F.when(F.col("seed"), 1.0).otherwise(F.round(1 - F.exp(F.coalesce("doubt", F.lit(0.0))), 9))
        again = scratch.save(scores.join(doubts, "instance", "left").select("instance", "seed", told.alias("score"), (told - F.col("score")).alias("rise")))
        rise = again.agg(F.max("rise").alias("x")).first().x
        for old in (trusted, scores):
            if old is not None:
                scratch.drop(old)
        trusted, scores = new, again.drop("rise")
        scores._scratch_path = again._scratch_path
        if not rise or rise <= SETTLED:
            return trusted, scores


def discover(found: DataFrame, scratch: Scratch, known: Column | None = None) -> DataFrame:
    """From base spans and tokens, (__key, extra): secrets and what contexts tell, as (kind, s, e). ``known`` may tell which
    instances can be seeds; what it leaves out is like any other token, so that recall can be measured."""
    rows = described(instances(found))
    if known is not None:
        rows = rows.withColumns({"base": F.col("base") & known, "secret": F.col("secret") & known, "told": F.col("told") | F.col("base")})
    rows = scratch.save(rows)
    seed = F.col("base") | F.col("secret")
    edges = rows.select("instance", F.explode("patterns").alias("pattern"), seed.alias("seed"), "told")
    edges = scratch.save(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("told").alias("told")))
    trusted, scores = scored(edges, scratch)
    chosen = scores.where(F.col("score") >= SURE).select("instance", F.col("seed").alias("known"))
    open_ = scratch.save(rows.where(~seed & F.col("told")).join(chosen, "instance"))
    hits = open_.select("__key", "s", "e", F.explode("patterns").alias("pattern")).join(trusted.select("pattern"), "pattern", "left_semi")
    hits = hits.select("__key", "s", "e").unionByName(open_.where("known").select("__key", "s", "e"))
    spans = rows.where("secret").select("__key", F.lit("secret").alias("kind"), "s", "e").unionByName(hits.select("__key", F.lit("context").alias("kind"), "s", "e"))
    # secrets stand before what contexts tell
    span = F.struct((F.col("kind") == "context").alias("later"), "s", "e", "kind")
    extra = F.transform(F.array_sort(F.collect_set(span)), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return spans.groupBy("__key").agg(extra.alias("extra"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, the spans of each kind, and ``extra``, the discovered ones (kind, start, end)."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(base_spans(docs))
    extra = scratch.save(discover(found, scratch))
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    return found.join(extra, "__key", "left").select("doc_id", *KINDS, F.coalesce("extra", none).alias("extra"))


def written(spans: str, kind: str | None = None) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(kind) if kind else x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base = F.concat(*[written(k, k) for k in KINDS])
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("extra")), ",").alias("spans"),
    )
