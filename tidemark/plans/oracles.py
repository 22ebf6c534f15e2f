"""The queries as SQL for another engine, over the same tables."""

from __future__ import annotations

import re

from ..sources import fulltext as ft
from . import adapters as ad
from . import vocabulary as v
from .rubric import DEFAULT

FLAT = "CASE WHEN {a} <= 30 THEN 1.0 WHEN {a} <= 90 THEN 0.75 WHEN {a} <= 180 THEN 0.5 ELSE 0.25 END"
NOISE = "('other', 'management_change_routine', 'board_change_routine', 'dilution', 'rpt_routine')"
RESULTS = "('earnings_beat', 'earnings_miss', 'guidance_change', 'operating_update')"
EVIDENCE = "(kind = 'news' AND event_type <> 'price_move' AND coalesce(substance, 'primary') <> 'passing')"
FEEDS = f"({EVIDENCE} AND NOT (sentiment = 0 AND event_type IN {NOISE}))"
IS_RES = f"(event_type IN {RESULTS} OR coalesce(pass_, '') = 'results')"


def band(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 1.6 THEN 2 WHEN {x} >= 0.5 THEN 1 WHEN {x} <= -1.6 THEN -2 WHEN {x} <= -0.5 THEN -1 ELSE 0 END"


def age(col: str, as_of: str) -> str:
    return f"date_diff('day', {col}, DATE '{as_of}')"


def window(col: str, as_of: str) -> str:
    a = age(col, as_of)
    return f"CASE WHEN {a} BETWEEN 0 AND 30 THEN 1 WHEN {a} BETWEEN 31 AND 90 THEN 2 WHEN {a} BETWEEN 91 AND 180 THEN 3 WHEN {a} BETWEEN 181 AND 365 THEN 4 END"


def weight(col: str, as_of: str) -> str:
    return FLAT.format(a=f"greatest({age(col, as_of)}, 0)")


ORD = f"ord AS (SELECT *, {window('published', ad.ORD_AS_OF)} AS win, {weight('published', ad.ORD_AS_OF)} AS w FROM ({ad.oracle(ad.ORD)}))"
ACT = f"act AS ({ad.oracle(ad.ACT)})"
PRICE = f"price AS ({ad.oracle(ad.PRICE)})"
EV = f"ev AS ({ad.oracle(ad.EV)})"
DOC = f"doc AS ({ad.oracle(ad.DOC_DUCK)})"


def weighted(rows: str, by: str, extra_mean: str = "{m}", w: str = "w") -> str:
    """CTEs ending in ``wm``: by, n_events, n_signal, weighted_mean."""
    return f"""sums AS (
  SELECT {by}, count(*) AS n_events, count(*) FILTER (sentiment <> 0) AS n_signal, sum({w} * sentiment) AS ws, sum({w}) AS wa,
    sum({w}) FILTER (sentiment <> 0) AS wsig, coalesce(bool_or(sentiment <= -1 AND {IS_RES}), false) AS off,
    sum({w} * sentiment) FILTER (sentiment <> 0 AND {IS_RES}) AS rws, sum({w}) FILTER (sentiment <> 0 AND {IS_RES}) AS rw
  FROM {rows} WHERE {FEEDS} GROUP BY {by}
), wm0 AS (SELECT *, CASE WHEN n_signal >= 3 THEN ws / wsig ELSE ws / wa END AS m FROM sums),
wm AS (SELECT {by}, n_events, n_signal, {extra_mean.format(m='m')} AS weighted_mean FROM wm0)"""


def banded(by: str) -> str:
    return f"SELECT {by}, n_events, n_signal, round(weighted_mean, 6) AS weighted_mean, {band('weighted_mean')} AS weighted_band FROM wm"


O: dict[str, str] = {}
O["recency_weighted_mean"] = f"WITH {ORD}, {weighted('ord', 'symbol')} {banded('symbol')}"
O["recency_weighted_mean_by_customer"] = (
    f"WITH {ORD}, o2 AS (SELECT * REPLACE (symbol || '/' || sector || '/' || CAST(year(published) AS VARCHAR) AS symbol) FROM ord), {weighted('o2', 'symbol')} {banded('symbol')}"
)
O["raw_mean_banded"] = f"""WITH {ORD}, m AS (SELECT symbol, sector, coalesce(avg(nullif(sentiment, 0)), avg(sentiment)) AS x FROM ord WHERE {FEEDS} GROUP BY symbol, sector)
SELECT symbol, sector, round(x, 6) AS raw_mean, {band('x')} AS raw_band FROM m"""
HALF = f"(greatest(0.15, pow(0.5, greatest({age('published', ad.ORD_AS_OF)}, 0) * 252.0 / 365.0 / 90.0)) * coalesce(confidence, 1.0))"
O["half_life_mean"] = f"WITH {ORD}, {weighted('ord', 'symbol', w=HALF)} {banded('symbol')}"
VETO = "CASE WHEN rws / rw <= 0.01 AND m1 > 0.01 THEN 0.01 ELSE m1 END"
O["vetoed_mean"] = f"""WITH {ORD}, {weighted('ord', 'symbol, sector')},
v1 AS (SELECT *, CASE WHEN n_signal >= 3 AND m > 0.98 AND off THEN 0.98 ELSE m END AS m1 FROM wm0),
v2 AS (SELECT *, {VETO} AS m2 FROM v1)
SELECT symbol, sector, n_events, n_signal, round(m2, 6) AS weighted_mean, {band('m2')} AS weighted_band FROM v2"""
O["score_bands"] = f"""WITH x AS (SELECT c_custkey, c_acctbal / 4000.0 - 0.7 AS x FROM customer), p AS (SELECT *, CAST(round_even(x * 50, 0) AS INT) AS points FROM x)
SELECT c_custkey, {band('x')} AS band, CAST(round(x) AS INT) AS whole, points, CAST(sign(points) AS INT) * CASE WHEN abs(points) >= 50 THEN 2 WHEN abs(points) >= 15 THEN 1 ELSE 0 END AS points_band FROM p"""
POOL = """news AS (SELECT *, lower(trim(coalesce(url, ''))) AS u FROM ord WHERE kind = 'news'),
pool AS (SELECT * FROM news WHERE u = '' UNION ALL SELECT * FROM news WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY sector, u ORDER BY holding_seq, seq) = 1)"""
O["sector_pooled_mean"] = f"WITH {ORD}, {POOL}, {weighted('pool', 'sector')} {banded('sector')}"
STANDARD = f"""st AS (
  SELECT symbol, count(*) AS n, count(*) FILTER ({IS_RES}) AS n_results, count(*) FILTER (event_type IN {RESULTS}) AS n_prints, count(DISTINCT win) AS n_windows,
    min(published) AS first, max(published) AS last, bool_or(confidence IS NOT NULL) AS event_mode FROM {{rows}} WHERE {EVIDENCE} GROUP BY symbol
), st2 AS (
  SELECT *, date_diff('day', first, last) AS span_days, CASE
    WHEN event_mode AND n < 6 THEN concat('only ', n, ' event(s)') WHEN event_mode AND n_windows < 2 THEN concat('only ', n_windows, ' window(s)')
    WHEN event_mode AND n_results < 1 THEN 'no results event' WHEN event_mode THEN '' WHEN n < 8 THEN concat('only ', n, ' article(s)') WHEN n_prints = 0 THEN 'no results item' ELSE '' END AS insufficient
  FROM st
)"""
O["evidence_standard"] = f"""WITH {ORD}, o2 AS (SELECT * REPLACE (symbol || '/' || sector AS symbol) FROM ord WHERE win IS NOT NULL), {STANDARD.format(rows='o2')}
SELECT symbol, n, n_results, n_windows, first, last, span_days, event_mode, insufficient, span_days < 270 AS collapsed FROM st2"""
SHARES = ", ".join(f"round(coalesce(sum(w) FILTER (f AND win = {k}), 0) / sum(w) FILTER (f), 6) AS share{k}" for k in range(1, 5))
O["coverage_map"] = f"""WITH {ORD}, r AS (SELECT *, {FEEDS} AS f FROM ord WHERE kind = 'news' AND win IS NOT NULL),
c AS (SELECT symbol, {", ".join(f"count(*) FILTER (f AND win = {k}) AS w{k}" for k in range(1, 5))}, count(*) FILTER (f) AS n_events,
  round(avg(CASE WHEN max_tier IN ('T1', 'T2') THEN 1.0 ELSE 0.0 END), 6) AS tier12_share, round(sum(coalesce(confidence, 1.0)) FILTER (f), 6) AS confidence_n, {SHARES} FROM r GROUP BY symbol)
SELECT *, n_events >= 6 AND greatest(w1, w2, w3, w4) / n_events > 0.7 AS dominated FROM c"""
TERMS = f"""t0 AS (SELECT *, count(*) FILTER (sentiment <> 0) OVER (PARTITION BY symbol) >= 3 AS use FROM ord WHERE {FEEDS}),
t1 AS (SELECT *, (NOT use OR sentiment <> 0) AS counted FROM t0),
t2 AS (SELECT *, CASE WHEN counted THEN w / sum(w) FILTER (counted) OVER (PARTITION BY symbol) END AS share FROM t1),
terms AS (SELECT *, share * sentiment AS push FROM t2)"""
O["drivers_topk"] = f"""WITH {ORD}, {TERMS}, s AS (SELECT *, CASE WHEN push > 0 THEN 'up' ELSE 'down' END AS side FROM terms WHERE counted AND push <> 0)
SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(push) DESC, seq) AS rank, seq, event_type, sentiment, round(share, 6) AS share, round(push, 6) AS push FROM s QUALIFY rank <= 3"""
O["driver_facts"] = f"""WITH {ORD}, {TERMS} SELECT symbol, count(*) FILTER (counted AND sentiment > 0) AS n_up, count(*) FILTER (counted AND sentiment < 0) AS n_down,
count(*) FILTER (NOT counted) AS n_not_counted, round(coalesce(sum(share) FILTER (counted AND {age('published', ad.ORD_AS_OF)} <= 90), 0), 6) AS recent_share FROM terms GROUP BY symbol"""
O["window_summary"] = f"""WITH {ORD}, g AS (SELECT DISTINCT symbol, k AS win FROM ord, (SELECT unnest([1, 2, 3, 4]) AS k)),
c AS (SELECT symbol, win, count(*) AS n, {", ".join(f"count(*) FILTER (sentiment = {k}) AS {x}" for k, x in ((-2, 'm2'), (-1, 'm1'), (0, 'zero'), (1, 'p1'), (2, 'p2')))} FROM ord WHERE win IS NOT NULL AND kind = 'news' GROUP BY symbol, win),
j AS (SELECT g.symbol, g.win, coalesce(n, 0) AS n, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ('m2', 'm1', 'zero', 'p1', 'p2'))} FROM g LEFT JOIN c ON g.symbol = c.symbol AND g.win = c.win)
SELECT *, CASE WHEN sum(n) OVER (PARTITION BY symbol) > 0 THEN round(n / sum(n) OVER (PARTITION BY symbol), 6) ELSE 0.0 END AS share FROM j"""
O["url_dedupe"] = f"""WITH {DOC}, r AS (SELECT *, lower(trim(coalesce(url, ''))) AS u FROM doc)
SELECT symbol, seq, url FROM r WHERE u = '' UNION ALL (SELECT symbol, seq, url FROM r WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY symbol, u ORDER BY seq) = 1)"""
UHASH = "substr(sha256(regexp_replace(lower(trim({u})), '/+$', '')), 1, 16)"
TKEY = "regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g')"
O["url_keys"] = f"""WITH {DOC} SELECT seq, {UHASH.format(u='url')} AS url_hash, {TKEY} AS title_key,
sha256(concat(url, chr(31), title, chr(31), snippet, chr(31), 'keyword', chr(31), 'v1')) AS item_key,
substr(sha1(concat(symbol, '|', CAST(published AS VARCHAR), '|', {UHASH.format(u='url')})), 1, 12) AS event_id FROM doc"""
COLLAPSE = f"""k AS (SELECT *, coalesce(nullif({TKEY}, ''), url, '') AS tk FROM doc),
uniq AS (SELECT *, count(*) OVER (PARTITION BY symbol, tk) - 1 AS n_copies FROM k QUALIFY row_number() OVER (PARTITION BY symbol, tk ORDER BY published DESC, relevance DESC, seq) = 1)"""
O["syndicated_collapse"] = f"WITH {DOC}, {COLLAPSE} SELECT symbol, seq, n_copies FROM uniq"
DAGE = age("published", ad.DOC_AS_OF)
O["window_of_article"] = f"""WITH {DOC} SELECT seq, {window('published', ad.DOC_AS_OF)} AS win, {weight('published', ad.DOC_AS_OF)} AS weight,
round(CASE WHEN {DAGE} > 182 THEN 1.0 - least(1.0, ({DAGE} - 182) / 183.0) * 0.5 ELSE 1.0 END, 6) AS taper, concat(year(published), 'Q', quarter(published)) AS quarter FROM doc"""
BOILER = "|".join(f"(?:{p})" for p in v.BOILERPLATE).replace("'", "''")
SAMPLED = f"""{COLLAPSE},
st AS (SELECT *, {window('published', ad.DOC_AS_OF)} AS win, CASE WHEN NOT usable THEN 'unusable' WHEN regexp_matches(coalesce(title, ''), '(?i){BOILER}') THEN 'boilerplate'
  WHEN {window('published', ad.DOC_AS_OF)} IS NULL THEN 'outside' END AS s0 FROM uniq),
pd AS (SELECT *, row_number() OVER (PARTITION BY symbol, published ORDER BY published DESC, relevance DESC, seq) <= 6 AS ok FROM st WHERE s0 IS NULL),
pool AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, win ORDER BY published DESC, relevance DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM pd),
av AS (SELECT symbol, {", ".join(f"count(*) FILTER (ok AND win = {k}) AS a{k}" for k in range(1, 5))} FROM pool GROUP BY symbol),
f1 AS (SELECT *, 40 AS w1, least(40, a1) AS g1 FROM av),
f2 AS (SELECT *, 25 + w1 - g1 AS w2, least(25 + w1 - g1, a2) AS g2 FROM f1),
f3 AS (SELECT *, 20 + w2 - g2 AS w3, least(20 + w2 - g2, a3) AS g3 FROM f2),
f4 AS (SELECT *, 15 + w3 - g3 AS w4, least(15 + w3 - g3, a4) AS g4 FROM f3),
b1 AS (SELECT *, w4 - g4 AS c1, least(w4 - g4, a1 - g1) AS r1 FROM f4),
b2 AS (SELECT *, c1 - r1 AS c2, least(c1 - r1, a2 - g2) AS r2 FROM b1),
b3 AS (SELECT *, c2 - r2 AS c3, least(c2 - r2, a3 - g3) AS r3 FROM b2),
b4 AS (SELECT *, c3 - r3 AS c4, least(c3 - r3, a4 - g4) AS r4 FROM b3),
plan AS ({" UNION ALL ".join(f"SELECT symbol, {k} AS win, g{k} + r{k} AS take, CASE WHEN c{k} > 0 THEN greatest(w{k}, g{k} + c{k}) ELSE w{k} END AS seen FROM b4" for k in range(1, 5))}),
sampled AS (
  SELECT p.symbol, p.seq, p.win, p.n_copies, CASE WHEN ok AND e < take THEN 'selected' WHEN NOT ok AND e < seen THEN 'extra' ELSE '{{rest}}' END AS status FROM pool p JOIN plan USING (symbol, win)
  UNION ALL SELECT symbol, seq, win, n_copies, s0 FROM st WHERE s0 IS NOT NULL
)"""
CAPPED, UNCAPPED = SAMPLED.replace("{rest}", "over_budget"), SAMPLED.replace("{rest}", "selected")
REASON = "CASE status WHEN 'unusable' THEN 'title does not name the company' WHEN 'boilerplate' THEN 'boilerplate headline' WHEN 'outside' THEN 'outside the lookback' WHEN 'over_budget' THEN 'over budget' END"
O["stratified_sample_capped"] = f"WITH {DOC}, {CAPPED} SELECT symbol, seq, win, status FROM sampled"
O["stratified_sample_uncapped"] = f"WITH {DOC}, {UNCAPPED} SELECT symbol, seq, win, status FROM sampled WHERE status IN ('selected', 'extra')"
O["drop_reasons"] = f"WITH {DOC}, {CAPPED} SELECT symbol, seq, status, {REASON} AS reason FROM sampled"
O["sample_report"] = f"WITH {DOC}, {CAPPED} SELECT symbol, status, count(*) AS n, CAST(sum(n_copies) AS BIGINT) AS copies FROM sampled GROUP BY symbol, status"
O["sample_carries"] = f"WITH {DOC}, {CAPPED} " + " UNION ALL ".join(f"SELECT symbol, {k} AS win, {q} AS quota, w{k} AS wanted, g{k} AS got, r{k} AS rolled_back FROM b4" for k, q in enumerate((40, 25, 20, 15), 1))
O["drop_counts_total"] = f"WITH {DOC}, {CAPPED}, d AS (SELECT symbol, {REASON} AS reason FROM sampled) SELECT symbol, reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY ROLLUP (symbol, reason)"
O["latest_n"] = f"WITH {DOC}, {COLLAPSE} SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY usable DESC, published DESC, relevance DESC, seq) AS rank FROM uniq QUALIFY rank <= 50"
NEW = "published DESC, relevance DESC, seq"
def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def candidates(rows: str, as_of: str, where: str = "true") -> str:
    """Rows that none of every seventh has, up to the quotas of four windows, with the sampler's carries."""
    return f"""k AS (SELECT *, regexp_replace(lower(trim(coalesce(url, ''))), '/+$', '') AS u, {TKEY} AS t FROM {rows}),
x AS (SELECT * FROM k WHERE seq % 7 = 0),
c0 AS (SELECT * FROM k WHERE {where} AND NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = k.symbol AND x.u = k.u) AND NOT EXISTS (SELECT 1 FROM x WHERE x.symbol = k.symbol AND x.t = k.t)),
c1 AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY symbol, u ORDER BY {NEW}) = 1),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY {NEW}) = 1),
c3 AS (SELECT *, {window('published', as_of)} AS win FROM c2 WHERE {window('published', as_of)} IS NOT NULL),
c4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY {NEW}) AS rn FROM c3),
av AS (SELECT symbol, {", ".join(f"count(*) FILTER (win = {k}) AS a{k}" for k in range(1, 5))} FROM c4 GROUP BY symbol),
f1 AS (SELECT *, 9 AS w1, least(9, a1) AS g1 FROM av), f2 AS (SELECT *, 8 + w1 - g1 AS w2, least(8 + w1 - g1, a2) AS g2 FROM f1),
f3 AS (SELECT *, 7 + w2 - g2 AS w3, least(7 + w2 - g2, a3) AS g3 FROM f2), f4 AS (SELECT *, 6 + w3 - g3 AS w4, least(6 + w3 - g3, a4) AS g4 FROM f3),
b1 AS (SELECT *, w4 - g4 AS c1, least(w4 - g4, a1 - g1) AS r1 FROM f4), b2 AS (SELECT *, c1 - r1 AS c2, least(c1 - r1, a2 - g2) AS r2 FROM b1),
b3 AS (SELECT *, c2 - r2 AS c3, least(c2 - r2, a3 - g3) AS r3 FROM b2), b4 AS (SELECT *, c3 - r3 AS c4, least(c3 - r3, a4 - g4) AS r4 FROM b3),
plan AS ({" UNION ALL ".join(f"SELECT symbol, {k} AS win, g{k} + r{k} AS take FROM b4" for k in range(1, 5))})
SELECT c4.symbol, seq, win FROM c4 JOIN plan USING (symbol, win) WHERE rn <= take"""


O["gov_candidates"] = f"WITH {DOC}, {candidates('doc', ad.DOC_AS_OF)}"
NUMBERED = "nu AS (SELECT * REPLACE (title || ' ' || CAST(seq AS VARCHAR) AS title), sentiment AS relevance FROM ord)"
O["governance_pass"] = f"WITH {ORD}, {NUMBERED}, {candidates('nu', ad.ORD_AS_OF, has('title', v.GOV_TITLE))}"
O["unique_filings"] = f"WITH {ORD} SELECT symbol, seq, published FROM ord QUALIFY row_number() OVER (PARTITION BY symbol, published, substr({TKEY}, 1, 80) ORDER BY seq) = 1"
O["articles_seen"] = f"""WITH {DOC}, {CAPPED}, hd AS (SELECT dd.symbol, coalesce(nullif({TKEY}, ''), url, '') AS th, dd.seq AS head, status, {REASON} AS why FROM (SELECT seq, status FROM sampled) sm JOIN doc dd ON sm.seq = dd.seq), it AS (SELECT symbol, seq, coalesce(nullif({TKEY}, ''), url, '') AS th FROM doc)
SELECT it.symbol, it.seq, CASE WHEN status IN ('selected', 'extra') AND it.seq <> head THEN 'syndicated copy' WHEN status = 'extra' THEN 'extra of its day' ELSE why END AS reason FROM it JOIN hd ON it.symbol = hd.symbol AND it.th = hd.th"""
O["fundamental_buckets"] = f"""WITH {DOC}, b AS (SELECT *, CAST(floor({DAGE} / 90.0) AS INT) AS bucket FROM doc),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, bucket ORDER BY {NEW}) AS rn FROM b QUALIFY rn <= 10)
SELECT symbol, seq, bucket, row_number() OVER (PARTITION BY symbol ORDER BY bucket, rn) AS rank FROM k QUALIFY rank <= 40"""
O["results_anchors"] = f"""WITH {DOC}, q AS (SELECT *, year(published) * 4 + quarter(published) AS quarter, seq % 7 AS n_sources FROM doc),
k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol, quarter ORDER BY n_sources DESC, published DESC, seq) = 1)
SELECT symbol, seq, quarter, row_number() OVER (PARTITION BY symbol ORDER BY quarter DESC) AS rank FROM k QUALIFY rank <= 4"""
O["month_histogram"] = f"""WITH {DOC}, d AS (SELECT * FROM doc), m AS (SELECT CAST(unnest(generate_series(DATE '2023-11-01', DATE '2024-12-31', INTERVAL 1 MONTH)) AS DATE) AS month),
g AS (SELECT DISTINCT symbol, month FROM d, m), c AS (SELECT symbol, CAST(date_trunc('month', published) AS DATE) AS month, count(*) AS n FROM d GROUP BY 1, 2)
SELECT g.symbol, g.month, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.symbol = c.symbol AND g.month = c.month"""


PRICED = "|".join(f"(?:{p})" for p in v.PRICE_LANGUAGE)
PRICE_ONLY = f"({has('title', PRICED)} AND NOT {has('title', v.FUNDAMENTAL)})"
STYLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(title || ' '), '{p}') THEN '{n}'" for n, p in v.STYLES) + " ELSE 'general-news' END"
O["title_filters"] = f"""WITH {ORD} SELECT seq, {has('title', BOILER)} AS boilerplate, {has('title', v.GOV_TITLE)} AS governance, {has('title', v.FUND_TITLE)} AS results, {PRICE_ONLY} AS price_only,
(contains(lower(title), 'company') OR contains(lower(title), 'cfo')) AS named, {STYLE} AS style FROM ord"""
LT = "lower(title || ' ')"
KIND = "CASE " + " ".join(f"WHEN regexp_matches({LT}, '{p}') THEN '{et}'" for p, et, _, _ in v.LABEL_RULES) + " ELSE 'other' END"
SENT = "CASE " + " ".join(f"WHEN regexp_matches({LT}, '{p}') THEN " + (f"(CASE WHEN contains({LT}, 'downgrade') THEN -1 WHEN contains({LT}, 'upgrade') THEN 1 ELSE 0 END)" if et == "analyst_action" else str(s)) for p, et, s, _ in v.LABEL_RULES) + " ELSE 0 END"
FLAG = "CASE " + " ".join(f"WHEN regexp_matches({LT}, '{p}') THEN {str(g).lower()}" for p, _, _, g in v.LABEL_RULES) + " ELSE false END"
O["keyword_label"] = f"""WITH {ORD}, l AS (SELECT seq, {KIND} AS event_type, {SENT} AS sentiment, {FLAG} AS governance_flag FROM ord)
SELECT seq, event_type, sentiment, governance_flag, true AS about_company, 'primary' AS substance, CASE WHEN governance_flag THEN 'company' END AS subject, CASE WHEN governance_flag THEN true END AS occurred_at_company,
CASE WHEN governance_flag AND event_type IN ('regulatory_action', 'auditor_resignation', 'auditor_restatement') THEN 'integrity' WHEN governance_flag THEN 'material' END AS severity,
CASE WHEN event_type = 'management_exit' THEN 'unplanned_exit' WHEN event_type = 'management_change_routine' AND governance_flag THEN 'appointment' END AS people_direction,
CASE WHEN event_type = 'management_exit' THEN 'cxo_cs_cfo_compliance' WHEN event_type = 'management_change_routine' AND governance_flag THEN 'senior_management' END AS role_tier,
CASE WHEN NOT governance_flag THEN NULL WHEN event_type = 'regulatory_action' THEN 'order_or_settlement' WHEN event_type = 'investigation' THEN 'investigation' WHEN event_type = 'management_change_routine' THEN 'routine' ELSE 'n/a' END AS action_stage FROM l"""
GATED = "governance_flag AND event_type IN ('regulatory_action', 'management_exit', 'exchange_fine', 'pledge')"
O["validate_rows"] = f"""WITH {ORD} SELECT seq, CASE WHEN trim(url) = '' THEN 'missing_source_url' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'invalid_source_url'
WHEN published > DATE '{ad.ORD_AS_OF}' THEN 'date_in_future' WHEN published < DATE '{ad.ORD_AS_OF}' - 730 THEN 'date_outside_lookback' WHEN seq % 23 = 0 THEN 'no_structured_output'
WHEN substance = 'boilerplate' THEN 'model_boilerplate' WHEN {GATED} AND subject IS NULL THEN 'incomplete_governance_verification:subject' WHEN {GATED} AND severity IS NULL THEN 'incomplete_governance_verification:severity'
WHEN {GATED} AND event_type = 'management_exit' AND people_direction IS NULL THEN 'incomplete_governance_verification:people_direction'
WHEN {GATED} AND event_type = 'management_exit' AND role_tier IS NULL THEN 'incomplete_governance_verification:role_tier'
WHEN {GATED} AND event_type IN ('regulatory_action', 'exchange_fine') AND action_stage IS NULL THEN 'incomplete_governance_verification:action_stage' END AS reason FROM ord"""
O["label_failures"] = f"WITH {ORD} SELECT count(*) AS n, round(avg(CASE WHEN seq % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) AS failure_share, avg(CASE WHEN seq % 7 = 0 THEN 1.0 ELSE 0.0 END) > 0.1 AS over_limit FROM ord"
O["price_lint"] = f"WITH {ORD} SELECT seq, 'price_move' AS event_type, 0 AS sentiment, false AS governance_flag FROM ord WHERE {PRICE_ONLY}"
TIERS = ", ".join(f"('{d}', '{t}')" for d, t in v.DOMAIN_TIERS.items())
O["tier_by_domain"] = f"""WITH known(dom, tier) AS (VALUES {TIERS}), p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'm.livemint.com' WHEN 1 THEN 'reuters.com'
  ELSE regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') END AS domain FROM pages),
h AS (SELECT p.page_id, arg_max(k.tier, length(k.dom)) AS tier FROM p JOIN known k ON p.domain = k.dom OR p.domain LIKE '%.' || k.dom GROUP BY p.page_id),
t AS (SELECT p.page_id, p.domain, coalesce(h.tier, 'T3') AS tier FROM p LEFT JOIN h USING (page_id)),
w AS (SELECT *, CASE tier WHEN 'T1' THEN 1.0 WHEN 'T2' THEN 0.9 WHEN 'T4' THEN 0.5 ELSE 0.7 END AS tier_weight FROM t)
SELECT page_id, domain, tier, tier_weight, round(least(1.0, 0.4 + 0.15 * ln(1.0 + page_id % 12)) * tier_weight, 6) AS confidence FROM w"""
STOP = "[" + ", ".join(f"'{w}'" for w in v.CLUSTER_STOP) + "]"
TOKENS = f"""list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]+', ' ', 'g')), ' +'),
  lambda w: length(w) >= 3 AND NOT (length(w) < 4 AND regexp_full_match(w, '[0-9]+')) AND NOT list_contains({STOP}, w)))"""
PAIRS = f"""tok AS (SELECT symbol, seq, published, {TOKENS} AS t FROM doc),
tf AS (SELECT symbol, token, count(*) AS n FROM (SELECT symbol, unnest(t) AS token FROM tok) GROUP BY symbol, token),
top AS (SELECT symbol, list(token) AS common FROM (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, token) <= 200) GROUP BY symbol),
pr AS (SELECT a.symbol, a.seq AS a, b.seq AS b, abs(date_diff('day', a.published, b.published)) AS gap, list_intersect(a.t, b.t) AS i, len(a.t) AS na, len(b.t) AS nb
  FROM tok a JOIN tok b ON a.symbol = b.symbol AND a.seq < b.seq AND abs(date_diff('day', a.published, b.published)) <= 7 WHERE len(a.t) > 0 AND len(b.t) > 0),
m AS (SELECT pr.symbol, a, b, gap, len(i) / (na + nb - len(i)) AS jaccard, len(i) / least(na, nb) AS contained, len(list_filter(i, lambda w: NOT list_contains(common, w))) AS shared, least(na, nb) AS small FROM pr JOIN top ON pr.symbol = top.symbol WHERE len(i) > 0),
pairs AS (SELECT *, jaccard >= 0.7 OR (contained >= 0.9 AND small >= 4) AS near FROM m WHERE jaccard >= 0.7 OR (contained >= 0.9 AND small >= 4) OR (gap <= 2 AND (jaccard >= 0.5 OR shared >= 3)))"""
O["title_pairs_similarity"] = f"WITH {DOC}, {PAIRS} SELECT symbol, a, b, gap, round(jaccard, 6) AS jaccard, round(contained, 6) AS contained, shared, near FROM pairs"
O["event_clusters"] = f"""WITH RECURSIVE {DOC}, {PAIRS}, e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(n, r) AS (SELECT seq, seq FROM doc UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.n WHERE reach.r < e.v) SELECT n AS seq, min(r) AS cluster FROM reach GROUP BY n"""
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
O["event_confidence"] = f"""WITH {DOC}, m AS (SELECT *, seq - seq % 5 AS cluster, {HOST} AS domain, {UHASH.format(u='url')} AS h FROM doc),
g AS (SELECT symbol, cluster, arg_min(seq, (published, -length(coalesce(snippet, '')), coalesce(title, ''), seq)) AS seq, count(*) AS n_members, count(DISTINCT domain) AS n_sources, min(published) AS event_date,
  array_to_string(list_sort(list_distinct(list(h))), ',') AS url_hashes, array_to_string(list_sort(list_distinct(list(domain))), ',') AS sources FROM m GROUP BY symbol, cluster)
SELECT g.symbol, g.seq, d.title, d.url, d.published, n_members, n_sources, 'T3' AS max_tier, event_date, url_hashes, sources, round(least(1.0, 0.4 + 0.15 * ln(1.0 + n_sources)) * 0.7, 6) AS confidence,
substr(sha1(concat(g.symbol, '|', CAST(event_date AS VARCHAR), '|', url_hashes)), 1, 12) AS event_id FROM g JOIN doc d ON g.seq = d.seq"""


def people() -> str:
    text = "concat(title, '. ', rationale)"
    return f"""(event_type = 'management_exit' AND (({has('title', v.BENIGN_PEOPLE)} AND NOT {has('title', v.EXIT_WORDS)}) OR ({has(text, v.RETIRED)} AND NOT {has('title', v.NOT_RETIRED)})
  OR ({has(text, v.ORDERLY)} AND NOT {has('title', v.ABRUPT)}) OR NOT {has(text, v.C_SUITE)}))"""


BASE = """CASE event_type WHEN 'auditor_restatement' THEN -25.0 WHEN 'auditor_resignation' THEN -20.0 WHEN 'regulatory_action' THEN -20.0 WHEN 'rpt_concern' THEN -12.0 WHEN 'investigation' THEN -10.0
  WHEN 'exchange_fine' THEN CASE coalesce(materiality, 'medium') WHEN 'low' THEN -5.0 WHEN 'high' THEN -10.0 ELSE -7.0 END WHEN 'management_exit' THEN -8.0 WHEN 'board_independence' THEN -8.0 WHEN 'pledge_invocation' THEN -20.0
  WHEN 'pledge' THEN CASE coalesce(materiality, 'medium') WHEN 'low' THEN 0.0 WHEN 'high' THEN -10.0 ELSE -5.0 END WHEN 'insolvency_admission' THEN -25.0 WHEN 'open_offer_takeover' THEN 0.0 END"""


def gated(rows: str, where: str = "governance_flag") -> str:
    """CTEs ending in ``gt``: the rows with bucket and penalty."""
    exempt = "event_type IN ('management_exit', 'auditor_resignation', 'auditor_restatement')"
    return f"""gb AS (SELECT *, {BASE} AS base FROM {rows} WHERE {where}),
gk AS (SELECT *, CASE WHEN penalty_override IS NOT NULL THEN 'override' WHEN base IS NULL THEN 'routine' WHEN subject IS NOT NULL AND subject NOT IN ('company', 'subsidiary', 'promoter_or_insider') THEN 'subject'
  WHEN NOT occurred_at_company AND coalesce(subject, '') NOT IN ('promoter_or_insider', 'subsidiary') THEN 'subject'
  WHEN event_type IN ('regulatory_action', 'investigation', 'exchange_fine') AND {has('title', v.VICTIM)} THEN 'subject'
  WHEN event_type = 'regulatory_action' AND {has('title', v.MACRO)} AND NOT {has('title', v.NAMED_ORDER)} THEN 'subject'
  WHEN {people()} THEN 'people' WHEN event_type = 'management_exit' AND people_direction IN ('appointment', 'promotion_or_elevation', 'reappointment', 'planned_exit_or_succession') THEN 'people'
  WHEN event_type = 'management_exit' AND role_tier IS NOT NULL AND role_tier <> 'cxo_cs_cfo_compliance' THEN 'people'
  WHEN action_stage = 'resolved_or_quashed' THEN 'resolved' WHEN action_stage = 'routine' AND event_type <> 'management_exit' THEN 'routine' ELSE 'penalty' END AS bucket,
  CASE WHEN event_type = 'regulatory_action' AND action_stage = 'notice_or_demand' THEN greatest(base, -10.0) ELSE base END AS p1 FROM gb),
gp AS (SELECT *, CASE WHEN NOT {exempt} AND severity IN ('procedural', 'immaterial') THEN greatest(p1, -5.0) WHEN NOT {exempt} AND severity = 'minor' THEN greatest(p1, -10.0) ELSE p1 END AS p2 FROM gk),
gt AS (SELECT *, CASE bucket WHEN 'override' THEN penalty_override WHEN 'penalty' THEN CASE WHEN NOT {exempt} AND coalesce(severity, '') NOT IN ('integrity', 'minor') AND amount_inr_cr < 10 THEN greatest(p2, -5.0) ELSE p2 END END AS penalty FROM gp)"""


def applied(rows: str, as_of: str, dedupe: bool = False) -> str:
    """CTEs ending in ``ap``: the penalties that count, with eff; the same-event step is left out or in."""
    a = age("published", as_of)
    fade = f"CASE WHEN {a} > 182 THEN 1.0 - least(1.0, ({a} - 182) / 183.0) * 0.5 ELSE 1.0 END"
    live = "penalty IS NOT NULL AND (NOT historical OR penalty_override IS NOT NULL)"
    first = f"lv AS (SELECT * FROM gt WHERE {live}), {same_event('lv')}," if dedupe else ""
    source = "lv WHERE (symbol, seq) NOT IN (SELECT (symbol, seq) FROM dup)" if dedupe else f"gt WHERE {live}"
    return f"""{gated(rows)}, {first}
al AS (SELECT *, CASE WHEN penalty_override IS NOT NULL THEN penalty ELSE round_even(penalty * ({fade}), 0) END AS eff FROM {source}),
ap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_type ORDER BY penalty_override IS NOT NULL DESC, eff, published DESC, seq) AS rn FROM al) WHERE rn = 1 OR penalty_override IS NOT NULL)"""


def same_event(rows: str, keys: str = "symbol") -> str:
    """CTEs ending in ``dup``: each row in turn, most severe first, against the rows of its symbol and family kept so
    far."""
    families = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in DEFAULT["governance"]["families"].items()) + " ELSE event_type END"
    stop = ", ".join(f"'{w}'" for w in v.EVENT_STOP)
    words = f"""list_filter(list_distinct(list_concat(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{{4,}}'), regexp_extract_all(lower(replace(coalesce(event_key, ''), '-', ' ')), '[a-z0-9]{{4,}}'))),
    lambda w: w <> lower(symbol) AND NOT list_contains(regexp_extract_all(lower(coalesce(company, '')), '[a-z0-9]{{4,}}'), w) AND w NOT IN ({stop}))"""
    shared = "len(list_intersect(x.words, c.words))"
    meets = f"""abs(date_diff('day', x.published, c.published)) <= {DEFAULT["governance"]["dedupe_days"]} AND ((c.k <> '' AND c.k = x.k)
    OR ({shared} >= 2 AND ({shared} / greatest(least(len(x.words), len(c.words)), 1) >= 0.5 OR abs(date_diff('day', x.published, c.published)) <= 3)))"""
    me = "struct_pack(seq := {0}seq, published := {0}published, k := {0}k, words := {0}words)"
    hit = f"list_filter(r.kept, lambda x: {meets})"
    return f"""se0 AS (SELECT symbol, seq, published, {families} AS family, regexp_replace(lower(coalesce(event_key, '')), '[^a-z0-9]', '', 'g') AS k, {words} AS words, penalty FROM {rows} WHERE published IS NOT NULL),
se AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY penalty, published, seq) AS nth FROM se0),
se_loop AS (SELECT symbol, family, nth, seq, [{me.format("")}] AS kept, CAST(NULL AS BIGINT) AS dup_of FROM se WHERE nth = 1
  UNION ALL SELECT c.symbol, c.family, c.nth, c.seq, CASE WHEN len({hit}) = 0 THEN list_append(r.kept, {me.format("c.")}) ELSE r.kept END, {hit}[1].seq
  FROM se_loop r JOIN se c ON c.symbol = r.symbol AND c.family = r.family AND c.nth = r.nth + 1),
dup AS (SELECT symbol, seq, dup_of FROM se_loop WHERE dup_of IS NOT NULL)"""


def governed(rows: str, as_of: str, dedupe: bool = False) -> str:
    """CTEs ending in ``gv``: the governance score of each symbol of ``rows``."""
    return f"""{applied(rows, as_of, dedupe)},
gs AS (SELECT symbol, sum(eff) AS penalty_sum, count(*) AS n_penalties FROM ap GROUP BY symbol),
gm AS (SELECT DISTINCT symbol FROM gt WHERE historical AND penalty_override IS NULL AND penalty IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ap WHERE ap.symbol = gt.symbol AND ap.event_type = gt.event_type)),
gv0 AS (SELECT h.symbol, coalesce(penalty_sum, 0.0) AS penalty_sum, coalesce(n_penalties, 0) AS n_penalties, CASE WHEN gm.symbol IS NOT NULL AND n_penalties IS NULL THEN -5.0 ELSE 0.0 END AS memory_discount
  FROM (SELECT DISTINCT symbol FROM {rows}) h LEFT JOIN gs ON h.symbol = gs.symbol LEFT JOIN gm ON h.symbol = gm.symbol),
gv AS (SELECT *, 100.0 + penalty_sum + memory_discount AS governance_score, CASE WHEN 100.0 + penalty_sum + memory_discount >= 95 THEN 'Clean' WHEN 100.0 + penalty_sum + memory_discount >= 80 THEN 'Watch' ELSE 'Flag' END AS governance_label FROM gv0)"""


O["governance_gate"] = f"WITH {ORD}, {gated('ord')} SELECT seq, bucket, penalty FROM gt"
O["governance_once_per_type"] = f"WITH {EV}, {applied('ev', ad.EV_AS_OF)} SELECT symbol, seq, event_type, penalty, eff FROM ap"
O["governance_score"] = f"WITH {EV}, {governed('ev', ad.EV_AS_OF)} SELECT symbol, penalty_sum, n_penalties, memory_discount, governance_score, governance_label FROM gv"
O["governance_same_event"] = f"WITH RECURSIVE {EV}, {gated('ev')}, pn AS (SELECT * FROM gt WHERE penalty IS NOT NULL), {same_event('pn')} SELECT symbol, seq, dup_of FROM dup"
O["governance_score_deduped"] = f"WITH RECURSIVE {EV}, {governed('ev', ad.EV_AS_OF, True)} SELECT symbol, penalty_sum, n_penalties, memory_discount, governance_score, governance_label FROM gv"
RUNNING = "100.0 + sum(eff) OVER (PARTITION BY symbol ORDER BY eff, published, seq ROWS UNBOUNDED PRECEDING)"
O["governance_running"] = f"WITH {EV}, {applied('ev', ad.EV_AS_OF)} SELECT symbol, seq, event_type, eff, {RUNNING} AS running FROM ap"

RESULT_TYPES = ", ".join(f"'{t}'" for t in DEFAULT["sentiment"]["results_event_types"])
TIER_WEIGHTS = " ".join(f"WHEN '{t}' THEN {float(w)}" for t, w in DEFAULT["tier_weight"].items())
ENTRY = "struct_pack(rep := {0}seq, pub := {0}published, d := {0}d, tier := {0}tier, purpose := {0}purpose, rows_ := [{0}seq], src := [{0}host], h := [{0}h])"
FITS = f"""abs(date_diff('day', x.d, c.d)) <= {DEFAULT["cluster"]["merge_days"]} OR (c.event_type IN ({RESULT_TYPES}) AND date_trunc('quarter', x.pub) = date_trunc('quarter', c.published) AND x.purpose = c.purpose)"""
OLD = "(x.tier < c.tier OR (x.tier = c.tier AND x.pub <= c.published))"  # the kept one stands for both
TAKEN = f"""struct_pack(rep := CASE WHEN {OLD} THEN x.rep ELSE c.seq END, pub := CASE WHEN {OLD} THEN x.pub ELSE c.published END, d := least(x.d, c.d, x.pub, c.published), tier := least(x.tier, c.tier),
  purpose := CASE WHEN (CASE WHEN {OLD} THEN c.purpose ELSE x.purpose END) = 'sentiment' THEN 'sentiment' WHEN {OLD} THEN x.purpose ELSE c.purpose END, rows_ := list_append(x.rows_, c.seq), src := list_distinct(list_append(x.src, c.host)), h := list_distinct(list_append(x.h, c.h)))"""
AT = f"list_position(list_transform(r.kept, lambda x: {FITS}), true)"
O["post_label_merge"] = f"""WITH RECURSIVE {EV}, pm AS (SELECT symbol, event_type, governance_flag, seq, published, coalesce(event_date, published) AS d, coalesce(max_tier, 'T3') AS tier, coalesce(purpose, '') AS purpose, {HOST} AS host, {UHASH.format(u='url')} AS h,
  row_number() OVER (PARTITION BY symbol, event_type, governance_flag ORDER BY published, title, seq) AS nth FROM ev WHERE published IS NOT NULL),
pm_loop AS (SELECT symbol, event_type, governance_flag, nth, [{ENTRY.format("")}] AS kept FROM pm WHERE nth = 1
  UNION ALL SELECT c.symbol, c.event_type, c.governance_flag, c.nth, CASE WHEN coalesce({AT}, 0) = 0 THEN list_append(r.kept, {ENTRY.format("c.")})
    ELSE list_transform(r.kept, lambda x, i: CASE WHEN i = {AT.replace("lambda x:", "lambda y:").replace("x.", "y.")} THEN {TAKEN} ELSE x END) END
  FROM pm_loop r JOIN pm c ON c.symbol = r.symbol AND c.event_type = r.event_type AND c.governance_flag = r.governance_flag AND c.nth = r.nth + 1),
pm_last AS (SELECT unnest(kept) AS x FROM (SELECT * FROM pm_loop QUALIFY nth = max(nth) OVER (PARTITION BY symbol, event_type, governance_flag)))
SELECT unnest(x.rows_) AS seq, x.rep AS survivor, x.d AS event_date, len(x.rows_) AS n_merged, x.purpose AS purpose, len(x.rows_) AS n_members, len(x.src) AS n_sources, x.tier AS max_tier,
  round(least(1.0, 0.4 + 0.15 * ln(1.0 + len(x.src))) * CASE x.tier {TIER_WEIGHTS} END, 6) AS confidence, array_to_string(list_sort(x.src), ',') AS sources, array_to_string(list_sort(x.h), ',') AS url_hashes FROM pm_last"""

NUMS = "list_sort(regexp_extract_all(replace(title, ',', ''), '[0-9]+(?:\\.[0-9]+)?'))"
SIG = f"CASE WHEN len({NUMS}) > 0 THEN {NUMS} ELSE list_sort(regexp_extract_all(lower(title), '[a-z]{{4,}}'))[1:6] END"
KNOWN = "('insolvency_admission', 'demerger', 'merger_acquisition', 'split_bonus', 'open_offer_takeover', 'rights_issue', 'pledge', 'pledge_invocation', 'dilution', 'special_dividend', 'auditor_resignation', 'management_exit', 'buyback', 'lock_in_expiry', 'dividend', 'name_symbol_isin_change', 'fy_end_change', 'routine_agm_egm', 'admin_notice', 'noise_notice'"
TRACKED = "'index_inclusion', 'index_exclusion', 'exchange_surveillance'"


def two(x: str) -> str:
    """To two places, exact halves to even, by the double's exact value."""
    high = "(s.v * 134217729.0 - (s.v * 134217729.0 - s.v))"
    parts = f"struct_pack(f := floor(s.p), d := s.p - floor(s.p), e := ({high} * 100.0 - s.p) + (s.v - {high}) * 100.0)"
    rounded = "(t.f + CASE WHEN t.d > 0.5 OR (t.d = 0.5 AND (t.e > 0 OR (t.e = 0 AND CAST(t.f AS BIGINT) % 2 <> 0))) THEN 1.0 ELSE 0.0 END) / 100.0"
    return f"list_transform(list_transform(list_transform([{x}], lambda v: struct_pack(v := v, p := v * 100.0)), lambda s: {parts}), lambda t: {rounded})[1]"


def unique(rows: str) -> str:
    return f"""us AS (SELECT *, {SIG} AS sig FROM {rows} WHERE event_type IN {KNOWN}, 'capacity_expansion', {TRACKED})),
ul AS (SELECT *, lag(published) OVER kind AS before, first_value(published) OVER kind AS oldest, row_number() OVER kind AS nth FROM us
  WINDOW kind AS (PARTITION BY symbol, event_type, sig ORDER BY published NULLS FIRST, seq)),
uq AS (SELECT * FROM ul WHERE nth = 1 OR oldest IS NOT NULL AND date_diff('day', before, published) > CASE WHEN event_type = 'dividend' THEN 120 ELSE 30 END)"""


def scored(rows: str, as_of: str, extra: str = "") -> str:
    sev = "CASE event_type WHEN 'insolvency_admission' THEN 10 WHEN 'demerger' THEN 9 WHEN 'merger_acquisition' THEN 9 WHEN 'split_bonus' THEN 8 WHEN 'open_offer_takeover' THEN 8 WHEN 'rights_issue' THEN 7 WHEN 'pledge' THEN 7 WHEN 'pledge_invocation' THEN 7 WHEN 'dilution' THEN 6 WHEN 'special_dividend' THEN 6 WHEN 'auditor_resignation' THEN 6 WHEN 'management_exit' THEN 6 WHEN 'buyback' THEN 5 WHEN 'lock_in_expiry' THEN 5 WHEN 'dividend' THEN 4 WHEN 'name_symbol_isin_change' THEN 3 WHEN 'fy_end_change' THEN 2 WHEN 'routine_agm_egm' THEN 2 WHEN 'admin_notice' THEN 1 WHEN 'noise_notice' THEN 0 END"
    half = "CASE WHEN event_type IN ('dividend', 'buyback', 'special_dividend') THEN 30.0 WHEN event_type IN ('pledge', 'pledge_invocation', 'auditor_resignation', 'management_exit') THEN 180.0 ELSE 90.0 END"
    return f"""sc0 AS (SELECT *, {sev} AS pts, coalesce(nullif(ca_stage, ''), 'board_approved') AS stage FROM {rows} WHERE event_type IN {KNOWN}, {TRACKED})),
sc1 AS (SELECT *, CASE stage WHEN 'board_intimation' THEN 0.3 WHEN 'approval_obtained' THEN 0.8 ELSE 0.6 END AS stage_mult,
  CASE WHEN ca_days_to_effective > 0 THEN CASE WHEN ca_days_to_effective < 15 THEN 1.0 WHEN ca_days_to_effective <= 60 THEN 0.75 ELSE 0.5 END ELSE greatest(0.1, pow(0.5, greatest({age('published', as_of)}, 0) / {half})) END AS timing_mult,
  CASE WHEN ca_size_pct IS NOT NULL THEN CASE WHEN ca_size_pct <= 2 THEN 0.7 WHEN ca_size_pct <= 5 THEN 1.0 WHEN ca_size_pct <= 10 THEN 1.2 ELSE 1.5 END
    WHEN event_type IN ('dilution', 'rights_issue', 'pledge', 'pledge_invocation', 'buyback', 'open_offer_takeover') AND materiality IS NOT NULL THEN CASE materiality WHEN 'low' THEN 0.7 WHEN 'high' THEN 1.5 ELSE 1.0 END ELSE 1.0 END AS size_mult,
  event_type IN ('insolvency_admission', 'pledge_invocation') OR (event_type = 'auditor_resignation' AND coalesce(severity, '') = 'integrity') AS gate_a,
  event_type IN ('split_bonus', 'demerger', 'merger_acquisition', 'rights_issue', 'special_dividend', 'name_symbol_isin_change') AS gate_b FROM sc0),
sc AS (SELECT *, {two('least(10.0, CAST(pts AS DOUBLE) * CAST(stage_mult AS DOUBLE) * CAST(timing_mult AS DOUBLE) * CAST(size_mult AS DOUBLE))')} AS score, CASE WHEN sentiment > 0 THEN 'positive' WHEN sentiment < 0 THEN 'negative' ELSE 'unclear' END AS direction,
  event_type IN ({TRACKED}) OR (stage = 'completed' AND NOT gate_a AND NOT gate_b) AS tracked_only FROM sc1)"""


def risked() -> str:
    live = "NOT tracked_only AND NOT gate_b AND coalesce(substance, 'primary') <> 'passing'"
    all_ = lambda on: two(f"10.0 * (1 - list_reduce(list_prepend(1.0, coalesce(list(1 - score / 10.0 ORDER BY published NULLS FIRST, seq) FILTER ({on}), [])), lambda x, y: x * y))")
    return f"""rk0 AS (SELECT symbol, {all_(f"{live} AND direction <> 'positive'")} AS risk, {all_(f"{live} AND direction = 'positive'")} AS opp,
  bool_or({live} AND gate_a) AS ex, count(*) FILTER ({live}) AS n_scored, count(*) FILTER (coalesce(substance, 'primary') <> 'passing' AND gate_b AND NOT tracked_only) AS n_quarantined, count(*) FILTER (coalesce(substance, 'primary') <> 'passing' AND tracked_only) AS n_tracked FROM sc GROUP BY symbol),
rk AS (SELECT symbol, CASE WHEN ex THEN 10.0 ELSE risk END AS risk_score, opp AS opportunity_score, CASE WHEN ex OR risk >= 9 THEN 'Exit' WHEN risk >= 7 THEN 'Act' WHEN risk >= 5 THEN 'Review' WHEN risk >= 3 THEN 'Watch' ELSE 'Log' END AS risk_band, opp >= 6 AS opportunity_review, n_scored, n_quarantined, n_tracked FROM rk0)"""


O["unique_actions"] = f"WITH {ACT}, {unique('act')} SELECT symbol, seq, event_type FROM uq"
O["action_event_score"] = f"WITH {ACT}, {scored('act', ad.ACT_AS_OF)} SELECT seq, event_type, stage, stage_mult, round(timing_mult, 6) AS timing_mult, size_mult, round(score, 6) AS score, direction, gate_a, gate_b, tracked_only FROM sc"
O["action_risk_opportunity"] = f"WITH {ACT}, {unique('act')}, {scored('uq', ad.ACT_AS_OF)}, {risked()} SELECT symbol, risk_score, opportunity_score, risk_band, opportunity_review, n_scored, n_quarantined, n_tracked FROM rk"
O["action_bands"] = """WITH s AS (SELECT p_partkey, p_partkey % 1001 AS hundredths, (p_partkey % 1001) / 100.0 AS score FROM part) SELECT p_partkey, hundredths, CASE WHEN score < 3 THEN 'Log' WHEN score < 5 THEN 'Watch' WHEN score < 7 THEN 'Review' WHEN score < 9 THEN 'Act' ELSE 'Exit' END AS band,
CASE WHEN score <= 2.9 + 1e-9 THEN 'Log' WHEN score >= 3 AND score <= 4.9 + 1e-9 THEN 'Watch' WHEN score >= 5 AND score <= 6.9 + 1e-9 THEN 'Review' WHEN score >= 7 AND score <= 8.9 + 1e-9 THEN 'Act' ELSE 'Exit' END AS strict_band FROM s"""
O["quarantined_actions"] = f"""WITH {ACT}, {scored('act', ad.ACT_AS_OF)} SELECT symbol, event_type, CASE WHEN count(DISTINCT direction) = 1 THEN min(direction) ELSE 'mixed' END AS direction, count(*) AS n,
arg_max(title, (published, seq)) AS newest FROM sc WHERE gate_b AND NOT tracked_only GROUP BY symbol, event_type"""
O["review_queue"] = f"""WITH {ACT}, {unique('act')}, {scored('uq', ad.ACT_AS_OF)}, {risked()} SELECT symbol, risk_score,
round(risk_score * p_retailprice / (SELECT avg(p_retailprice) FROM part), 6) AS priority FROM rk JOIN part ON symbol = p_partkey"""
O["relative_zscores"] = f"""WITH {ORD}, {weighted('ord', 'symbol')}, z AS (SELECT avg(weighted_mean) AS m, stddev_pop(weighted_mean) AS s FROM wm)
SELECT symbol, round(weighted_mean, 6) AS weighted_mean, round((least(greatest(weighted_mean, m - 3 * s), m + 3 * s) - m) / s, 6) AS weighted_mean_z FROM wm, z"""


def back(name: str, days: int) -> str:
    return f"CASE WHEN n >= 2 THEN last_close / arg_max(close, CASE WHEN date_diff('day', date, last_date) >= {days} THEN date END) FILTER (date_diff('day', date, last_date) >= {days}) - 1 END AS {name}"


ASOF = "pr AS (SELECT * FROM price WHERE date <= DATE '2001-06-30'), la AS (SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_close, count(*) AS n FROM pr GROUP BY symbol)"
RETS = f"rt AS (SELECT symbol, last_date, {back('ret_1m', 30)}, {back('ret_3m', 91)}, {back('ret_6m', 182)} FROM pr JOIN la USING (symbol) GROUP BY symbol, last_date, last_close, n)"
O["price_returns_asof"] = f"WITH {PRICE}, {ASOF}, {RETS} SELECT symbol, last_date, round(ret_1m, 6) AS ret_1m, round(ret_3m, 6) AS ret_3m, round(ret_6m, 6) AS ret_6m FROM rt"
O["realised_vol"] = f"""WITH {PRICE}, l AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM price)
SELECT symbol, CASE WHEN count(*) >= 3 AND count(r) >= 2 THEN round(stddev_samp(r) * sqrt(252.0), 6) END AS realised_vol FROM l GROUP BY symbol"""
O["price_quadrant"] = f"""WITH {PRICE}, {ASOF}, {RETS}, bp AS (SELECT date, max(close) AS close FROM pr GROUP BY date), bl AS (SELECT max(date) AS d, arg_max(close, date) AS c FROM bp),
bm AS (SELECT any_value(bl.c) / arg_max(bp.close, bp.date) FILTER (date_diff('day', bp.date, bl.d) >= 30) - 1 AS bench FROM bp, bl),
x AS (SELECT symbol, ret_1m, bench, ret_1m - bench AS excess, CAST(symbol % 3 AS INT) - 1 AS s FROM rt, bm)
SELECT symbol, round(ret_1m, 6) AS ret_1m, round(bench, 6) AS bench_1m, round(excess, 6) AS excess_1m, CASE WHEN excess IS NULL THEN 'n/a' WHEN s < 0 AND excess < 0 THEN 'negative & underperformed: priced-in' WHEN s < 0 THEN 'negative & not sold off: potential unpriced risk'
WHEN s > 0 AND excess > 0 THEN 'positive & outperformed: confirmed' WHEN s > 0 THEN 'positive & lagging: not yet reflected' ELSE 'neutral sentiment' END AS quadrant FROM x"""

RUNS = f"""{EV}, man(run_id, as_of, fetched, mode) AS (VALUES ('run0', DATE '2024-01-05', DATE '2024-01-05', 'live'), ('run1', DATE '2024-01-12', DATE '2024-01-12', 'live'), ('run2', DATE '2024-01-19', DATE '2024-02-19', 'live'),
  ('run3', DATE '2024-01-26', DATE '2024-01-26', 'pit-replay'), ('run9', DATE '2024-01-28', DATE '2024-01-28', 'archive')),
runs AS (SELECT seq AS event_id, symbol, event_date, sentiment, concat('run', run) AS run_id FROM ev UNION ALL SELECT seq, symbol, event_date, -sentiment, 'run9' FROM ev WHERE seq % 3 = 0)"""
O["latest_copy"] = f"WITH {RUNS} SELECT event_id, run_id, sentiment FROM runs QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY run_id DESC) = 1"
O["pit_visible_events"] = f"""WITH {RUNS} SELECT event_id, run_id, event_date, sentiment FROM runs JOIN man USING (run_id) WHERE as_of <= DATE '2024-01-22' AND mode <> 'pit-replay' AND event_date <= DATE '2024-01-15'
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY run_id DESC) = 1"""
O["pit_visible_strict"] = f"""WITH {RUNS} SELECT event_id, run_id, sentiment FROM runs JOIN man USING (run_id) WHERE as_of <= DATE '2024-01-29' AND fetched <= DATE '2024-01-29' AND mode <> 'pit-replay' AND event_date <= DATE '2024-01-22'
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY run_id DESC) = 1"""
O["backtest_weekly"] = f"""WITH {RUNS}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-03', DATE '2024-01-31', INTERVAL 7 DAY)) AS DATE) AS day),
s AS (SELECT d.day AS as_of, runs.* FROM runs JOIN man USING (run_id), d WHERE event_date <= d.day AND man.as_of <= d.day + 7 AND mode <> 'pit-replay' QUALIFY row_number() OVER (PARTITION BY d.day, event_id ORDER BY run_id DESC) = 1)
SELECT as_of, symbol, count(*) AS n, round(avg(sentiment), 6) AS mean FROM s GROUP BY as_of, symbol"""

O["batched_labels"] = f"""WITH {EV} SELECT seq, CASE WHEN seq % 97 <> 0 AND seq % 13 <> 0 THEN event_type END AS event_type,
CASE WHEN seq % 97 = 0 THEN 'ValueError: this batch can''t be read' WHEN seq % 13 = 0 THEN 'no label in the reply' END AS label_error FROM ev"""
O["tolerant_replies"] = f"WITH {EV} SELECT CAST(seq // 8 AS BIGINT) AS block, CAST(seq AS VARCHAR) AS id, event_type FROM ev QUALIFY (seq // 8) % 4 <> 2 OR seq <> max(seq) OVER (PARTITION BY seq // 8)"
RUNS_W = RUNS.replace("event_date, sentiment, concat", "event_date, published, event_type, kind, sentiment, concat").replace("event_date, -sentiment", "event_date, published, event_type, kind, -sentiment")
O["backtest_daily_sweep"] = f"""WITH {RUNS_W}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
s AS (SELECT d.day, runs.* FROM runs JOIN man USING (run_id), d WHERE event_date <= d.day AND man.as_of <= d.day + 7 AND mode <> 'pit-replay' QUALIFY row_number() OVER (PARTITION BY d.day, event_id ORDER BY run_id DESC) = 1),
w AS (SELECT day AS as_of, symbol, sentiment AS s, event_type IN {RESULTS} AS res, CAST({FLAT.format(a="greatest(date_diff('day', published, day), 0)")} AS DOUBLE) * (event_id % 7 / 8.0 + 0.25) AS w
  FROM s WHERE event_type <> 'price_move' AND NOT (sentiment = 0 AND event_type IN {NOISE})),
a AS (SELECT as_of, symbol, count(*) AS n_events, count(*) FILTER (s <> 0) AS n_signal, sum(w * s) AS ws, sum(w) AS wa, sum(w) FILTER (s <> 0) AS wg, coalesce(bool_or(res AND s <= -1), FALSE) AS off FROM w GROUP BY as_of, symbol),
m AS (SELECT *, ws / CASE WHEN n_signal >= 3 THEN wg ELSE wa END AS m0 FROM a), v AS (SELECT *, CASE WHEN n_signal >= 3 AND m0 > 49.0 / 50.0 AND off THEN 49.0 / 50.0 ELSE m0 END AS m1 FROM m)
SELECT as_of, symbol, n_events, n_signal, round(m1, 6) AS weighted_mean, {band("m1")} AS weighted_band FROM v"""


def half(name: str, where: str) -> str:
    inner = weighted(f"(SELECT * FROM ord WHERE {where})", "symbol")
    for cte in ("sums", "wm0", "wm"):
        inner = inner.replace(f"{cte} AS", f"{cte}_{name} AS").replace(f"FROM {cte})", f"FROM {cte}_{name})")
    return f"{inner}, {name} AS (SELECT symbol, weighted_mean, CAST({band('weighted_mean')} AS DOUBLE) AS band FROM wm_{name})"


HALVES = f"{ORD}, {half('ha', ad.RUN_A)}, {half('hb', ad.RUN_B)}"
O["run_delta"] = f"WITH {HALVES} SELECT a.symbol, round(a.weighted_mean, 6) AS weighted_mean, round(b.weighted_mean, 6) AS weighted_mean_before, round(a.weighted_mean - b.weighted_mean, 6) AS weighted_mean_change FROM ha a LEFT JOIN hb b ON a.symbol = b.symbol"


def same(c: str) -> str:
    return f"coalesce(abs(a.{c} - b.{c}) <= 1e-9, a.{c} IS NULL AND b.{c} IS NULL)"


DIFF = f"""df AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.weighted_mean AS weighted_mean_a, a.band AS band_a, b.weighted_mean AS weighted_mean_b, b.band AS band_b, {same('weighted_mean')} AS weighted_mean_same, {same('band')} AS band_same,
CASE WHEN a.symbol IS NULL OR b.symbol IS NULL THEN 'U' WHEN {same('weighted_mean')} AND {same('band')} THEN '=' ELSE 'C' END AS code FROM ha a FULL OUTER JOIN hb b ON a.symbol = b.symbol)"""
O["run_diff"] = f"WITH {HALVES}, {DIFF} SELECT * REPLACE (round(weighted_mean_a, 6) AS weighted_mean_a, round(weighted_mean_b, 6) AS weighted_mean_b) FROM df"
O["run_agreement"] = f"WITH {HALVES}, {DIFF} SELECT count(*) AS n_both, round(avg(CASE WHEN band_same THEN 1.0 ELSE 0.0 END), 6) AS band_agreement FROM df WHERE code <> 'U'"
O["run_verify"] = f"""WITH {ORD}, {half('va', 'TRUE')}, {half('vb', ad.RUN_AGAIN)} SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL OR b.symbol IS NULL THEN 'U' ELSE 'C' END AS code
FROM va a FULL OUTER JOIN vb b ON a.symbol = b.symbol WHERE a.symbol IS NULL OR b.symbol IS NULL OR NOT {same('weighted_mean')}"""
O["run_merge"] = f"""WITH {ORD}, u AS (SELECT *, 0 AS r FROM ord WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM ord WHERE seq % 2 <> 0 OR seq % 3 = 0)
SELECT symbol, seq, url FROM u QUALIFY row_number() OVER (PARTITION BY symbol, coalesce(nullif(trim(url), ''), title) ORDER BY r, seq) = 1"""
HALF_A, HALF_B = applied("ea", ad.EV_AS_OF), applied("eb", ad.EV_AS_OF)
for _cte in ("gb", "gk", "gp", "gt", "al", "ap"):
    HALF_B = HALF_B.replace(f"{_cte} AS", f"{_cte}2 AS").replace(f"FROM {_cte})", f"FROM {_cte}2)").replace(f"FROM {_cte} ", f"FROM {_cte}2 ")
O["penalty_changes"] = f"""WITH {EV}, ea AS (SELECT * FROM ev WHERE seq % 2 = 0), eb AS (SELECT * FROM ev WHERE seq % 2 <> 0 OR seq % 3 = 0), {HALF_A}, {HALF_B}, xa AS (SELECT symbol, event_type, sum(eff) AS eff FROM ap GROUP BY ALL), xb AS (SELECT symbol, event_type, sum(eff) AS eff FROM ap2 GROUP BY ALL)
SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.event_type, y.event_type) AS event_type, x.eff AS a, y.eff AS b, CASE WHEN x.eff IS NULL THEN 'only in b' WHEN y.eff IS NULL THEN 'only in a' ELSE 'changed' END AS change
FROM xa x FULL OUTER JOIN xb y ON x.symbol = y.symbol AND x.event_type = y.event_type WHERE x.eff IS DISTINCT FROM y.eff"""
O["label_cache_miss"] = f"""WITH {DOC}, k AS (SELECT seq, {UHASH.format(u='url')} AS item_key FROM doc) SELECT seq, item_key FROM k WHERE item_key NOT IN (SELECT item_key FROM k WHERE seq % 5 = 0 OR seq % 7 = 0)"""
XHASH = UHASH.format(u="concat('x', url)")
O["label_from_cache"] = f"""WITH {DOC}, k AS (SELECT seq, {TKEY} AS item_key, {UHASH.format(u='url')} AS h, {XHASH} AS hx FROM doc),
c AS (SELECT item_key, CAST(min(seq) AS VARCHAR) AS a FROM k WHERE seq % 4 = 0 GROUP BY item_key), i AS (SELECT CASE WHEN seq % 2 = 0 THEN h ELSE hx END AS uh, CAST(min(seq) AS VARCHAR) AS b FROM k WHERE seq % 5 = 1 GROUP BY 1),
m AS (SELECT k.seq, arg_min(i.b, i.uh) AS m FROM k JOIN i ON i.uh = k.h OR i.uh = k.hx GROUP BY k.seq)
SELECT k.seq, coalesce(c.a, i.b, m.m) AS label, CASE WHEN c.a IS NOT NULL THEN 'cache' WHEN i.b IS NOT NULL THEN 'corpus' WHEN m.m IS NOT NULL THEN 'member' ELSE 'label' END AS label_source
FROM k LEFT JOIN c ON k.item_key = c.item_key LEFT JOIN i ON k.h = i.uh LEFT JOIN m ON k.seq = m.seq"""
O["corpus_union"] = f"""WITH {EV}, k AS (SELECT symbol, seq AS event_id, event_date, governance_flag, {UHASH.format(u='url')} AS h FROM ev), n AS (SELECT DISTINCT symbol, h FROM k WHERE event_id % 6 = 0),
s AS (SELECT * FROM k WHERE event_id % 6 <> 0 AND governance_flag AND event_date BETWEEN DATE '{ad.EV_AS_OF}' - 20 AND DATE '{ad.EV_AS_OF}' AND NOT EXISTS (SELECT 1 FROM n WHERE n.symbol = k.symbol AND n.h = k.h))
SELECT symbol, event_id FROM s QUALIFY row_number() OVER (PARTITION BY symbol, h ORDER BY event_date, event_id) = 1"""
O["universe_added_removed"] = """WITH a AS (SELECT DISTINCT upper(trim(c_name)) AS symbol FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT upper(trim(c_name)) AS symbol FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 = 0)
SELECT symbol, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT symbol, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
O["universe_hash"] = "SELECT sha256(string_agg(s, chr(10) ORDER BY s)) AS universe_hash FROM (SELECT DISTINCT upper(n_name) AS s FROM nation)"
ORD_ACT = f"ordact AS (SELECT *, CAST(NULL AS VARCHAR) AS ca_stage, CAST(NULL AS DOUBLE) AS ca_size_pct, CAST(NULL AS DOUBLE) AS ca_days_to_effective FROM ord)"
PORTFOLIO = f"""{ORD}, {weighted('ord', 'symbol')}, hold AS (SELECT symbol, min(sector) AS sector FROM ord GROUP BY symbol), rawm AS (SELECT symbol, coalesce(avg(nullif(sentiment, 0)), avg(sentiment)) AS x FROM ord WHERE {FEEDS} GROUP BY symbol),
{STANDARD.format(rows='ord')}, {governed('ord', ad.ORD_AS_OF, True)}, {ORD_ACT}, {unique('ordact')}, {scored('uq', ad.ORD_AS_OF)}, {risked()},
{POOL}, {weighted('pool', 'sector').replace('sums AS', 'sums_s AS').replace('FROM sums)', 'FROM sums_s)').replace('wm0 AS', 'wm0_s AS').replace('FROM wm0)', 'FROM wm0_s)').replace('wm AS', 'wm_s AS')},
pf0 AS (SELECT h.symbol, h.sector, wm.weighted_mean, rawm.x, wm_s.weighted_mean AS sm, gv.governance_score, gv.governance_label, rk.risk_score, rk.opportunity_score, rk.risk_band, wm.n_events, nullif(st2.insufficient, '') AS ins, st2.n, coalesce(st2.span_days < 270, false) AS collapsed
  FROM hold h LEFT JOIN wm ON h.symbol = wm.symbol LEFT JOIN rawm ON h.symbol = rawm.symbol LEFT JOIN st2 ON h.symbol = st2.symbol LEFT JOIN gv ON h.symbol = gv.symbol LEFT JOIN rk ON h.symbol = rk.symbol LEFT JOIN wm_s ON h.sector = wm_s.sector),
pf AS (SELECT symbol, sector, CASE WHEN note IS NULL THEN weighted_mean END AS sentiment_mean, CASE WHEN note IS NULL THEN {band('weighted_mean')} END AS sentiment_band, x AS raw_mean, {band('x')} AS raw_band, {band('sm')} AS sector_sentiment,
  governance_score, governance_label, coalesce(risk_score, 0.0) AS risk_score, coalesce(opportunity_score, 0.0) AS opportunity_score, coalesce(risk_band, 'Log') AS risk_band, coalesce(n_events, 0) AS n_events, coalesce(n_events, 0) < 3 OR note IS NOT NULL OR collapsed AS low_confidence, note
  FROM (SELECT *, coalesce(ins, CASE WHEN n IS NULL THEN 'no evidence' END) AS note FROM pf0))"""
O["score_portfolio"] = f"WITH RECURSIVE {PORTFOLIO} SELECT * REPLACE (round(sentiment_mean, 6) AS sentiment_mean, round(raw_mean, 6) AS raw_mean, round(risk_score, 6) AS risk_score, round(opportunity_score, 6) AS opportunity_score) FROM pf"
O["narration"] = f"""WITH RECURSIVE {PORTFOLIO}, {TERMS}, sd AS (SELECT *, CASE WHEN push > 0 THEN 'up' ELSE 'down' END AS side FROM terms WHERE counted AND push <> 0),
dr AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY abs(push) DESC, seq) <= 3),
tp AS (SELECT symbol, string_agg(line, '; ' ORDER BY k, line) AS pushes FROM (SELECT symbol, -abs(push) AS k, event_type || ' ' || format('{{:,.2f}}', push) AS line FROM dr) GROUP BY symbol)
SELECT pf.symbol, pf.symbol || ': ' || CASE WHEN sentiment_band IS NULL THEN 'Sentiment not scored: ' || coalesce(note, '') ELSE 'Sentiment ' || CAST(sentiment_band AS VARCHAR) END
  || '. Governance ' || governance_label || '. Action risk ' || risk_band || '.' || coalesce(' Pushes: ' || pushes || '.', '') AS commentary FROM pf LEFT JOIN tp ON pf.symbol = tp.symbol"""
O["portfolio_facts"] = f"""WITH RECURSIVE {PORTFOLIO} SELECT count(*) AS n, {", ".join(f"count(*) FILTER (sentiment_band = {k}) AS {x}" for k, x in ((-2, 'm2'), (-1, 'm1'), (0, 'zero'), (1, 'p1'), (2, 'p2')))},
count(*) FILTER (sentiment_band IS NULL) AS unscored, {", ".join(f"count(*) FILTER (governance_label = '{x}') AS {x.lower()}" for x in ('Clean', 'Watch', 'Flag'))}, {", ".join(f"count(*) FILTER (risk_band = '{x}') AS risk_{x.lower()}" for x in ('Review', 'Act', 'Exit'))},
count(*) FILTER (low_confidence) AS low_confidence FROM pf"""
O["score_workings"] = f"""WITH RECURSIVE {ORD}, {TERMS}, {weighted('ord', 'symbol')}, {applied('ord', ad.ORD_AS_OF, True)}, {ORD_ACT}, {unique('ordact')}, {scored('uq', ad.ORD_AS_OF)}
SELECT symbol, CASE WHEN counted THEN 'sentiment term' ELSE 'not counted' END AS part, seq, event_type AS label, round(push, 6) AS value, NULL::DOUBLE AS running FROM terms
UNION ALL SELECT symbol, 'sentiment mean', NULL, '', round(weighted_mean, 6), NULL FROM wm
UNION ALL SELECT symbol, 'penalty', seq, event_type, eff, {RUNNING} FROM ap UNION ALL SELECT symbol, 'not penalised', seq, bucket, NULL, NULL FROM gt WHERE penalty IS NULL
UNION ALL SELECT symbol, 'action', seq, event_type, round(score, 6), NULL FROM sc"""
SPLIT_A, SPLIT_B = governed("ea", ad.EV_AS_OF), governed("eb", ad.EV_AS_OF)
for _cte in ("gb", "gk", "gp", "gt", "al", "ap", "gs", "gm", "gv0", "gv"):
    SPLIT_B = SPLIT_B.replace(f"{_cte} AS", f"{_cte}2 AS").replace(f"FROM {_cte})", f"FROM {_cte}2)").replace(f"FROM {_cte} ", f"FROM {_cte}2 ").replace(f"JOIN {_cte} ", f"JOIN {_cte}2 ").replace(f"{_cte}.", f"{_cte}2.")
O["label_split"] = f"""WITH {EV}, ea AS (SELECT * FROM ev WHERE seq % 2 = 0), eb AS (SELECT * FROM ev WHERE seq % 2 <> 0 OR seq % 3 = 0), {SPLIT_A}, {SPLIT_B},
x AS (SELECT governance_label AS label, count(*) AS n FROM gv GROUP BY 1), y AS (SELECT governance_label AS label, count(*) AS n_before FROM gv2 GROUP BY 1), t AS (SELECT sum(n) AS total FROM x),
j AS (SELECT coalesce(x.label, y.label) AS label, coalesce(n, 0) AS n, coalesce(n_before, 0) AS n_before FROM x FULL OUTER JOIN y ON x.label = y.label)
SELECT label, n, n_before, round(n / total, 6) AS share, (label = 'Clean' AND n / total >= 0.6) OR (label = 'Flag' AND n / total >= 0.3) AS noted FROM j, t"""
KIND_OF = "CASE {0}.event_type WHEN 'regulatory_action' THEN 'reg' WHEN 'investigation' THEN 'reg' WHEN 'exchange_fine' THEN 'reg' WHEN 'management_exit' THEN 'people' WHEN 'board_independence' THEN 'people' WHEN 'rpt_concern' THEN 'rpt' END"
OTHER_RUN = governed("ord", ad.ORD_AS_OF)
for _cte in re.findall(r"(\w+) AS \(", OTHER_RUN):
    OTHER_RUN = re.sub(rf"\b{_cte}\b", f"{_cte}_x", OTHER_RUN)
O["anomaly_proposals"] = f"""WITH RECURSIVE {PORTFOLIO}, {OTHER_RUN}, pr(kind, key) AS (
SELECT 'benign_people_penalised', concat(symbol, '|', seq) FROM ap WHERE event_type = 'management_exit' AND coalesce(role_tier, '') <> 'cxo_cs_cfo_compliance'
UNION SELECT 'immaterial_heavy_penalty', concat(symbol, '|', seq) FROM ap WHERE coalesce(materiality, '') = 'low' AND eff <= -15
UNION SELECT 'collapsed_window', symbol FROM st2 WHERE span_days < 270 AND insufficient = '' UNION SELECT 'insufficient_data', symbol FROM st2 WHERE insufficient <> ''
UNION SELECT 'many_flags', 'portfolio' FROM pf HAVING avg(CASE WHEN governance_label = 'Flag' THEN 1.0 ELSE 0.0 END) >= 0.3 UNION SELECT 'many_clean', 'portfolio' FROM pf HAVING avg(CASE WHEN governance_label = 'Clean' THEN 1.0 ELSE 0.0 END) >= 0.6
UNION SELECT 'compressed_sentiment', 'portfolio' FROM pf HAVING stddev_pop(sentiment_mean) < 0.25
UNION SELECT 'loose_query', symbol FROM ord GROUP BY symbol HAVING count(*) FILTER (seq % 10 < holding_seq % 10) >= 5 AND count(*) FILTER (seq % 10 < holding_seq % 10) / count(*) >= 0.4
UNION SELECT 'label_failures', symbol FROM ord WHERE seq % 7 = 0 AND holding_seq % 3 = 0
UNION SELECT 'price_language', CAST(count(*) AS VARCHAR) FROM ord WHERE event_type = 'price_move' HAVING count(*) > 0
UNION SELECT 'verified_event_missed', concat(symbol, '|', coalesce(event_key, '')) FROM ord o WHERE penalty_override IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ord f WHERE f.penalty_override IS NULL AND f.governance_flag AND f.symbol = o.symbol AND {KIND_OF.format('f')} = {KIND_OF.format('o')})
UNION SELECT 'runs_disagree', concat(pf.symbol, '|', CAST(pf.governance_score AS VARCHAR), '|', CAST(x.governance_score AS VARCHAR)) FROM pf JOIN gv_x x ON pf.symbol = x.symbol WHERE pf.governance_score <> x.governance_score)
SELECT kind, key, concat('L-', substr(sha1(concat(kind, '|', key)), 1, 8)) AS lesson_id FROM pr"""


def zscore(c: str) -> str:
    m, sd = f"(SELECT avg({c}) FROM pf)", f"(SELECT stddev_pop({c}) FROM pf)"
    return f"round(CASE WHEN {c} IS NULL OR (SELECT count({c}) FROM pf) < 2 THEN NULL WHEN {sd} = 0 THEN 0.0 ELSE (least(greatest({c}, {m} - 3 * {sd}), {m} + 3 * {sd}) - {m}) / {sd} END, 6) AS {c}_z"


O["view_scorecard"] = f"WITH RECURSIVE {PORTFOLIO} SELECT symbol, sentiment_band, governance_score, {zscore('sentiment_mean')}, {zscore('governance_score')}, {zscore('risk_score')}, DATE '{ad.ORD_AS_OF}' AS as_of FROM pf"
O["view_articles"] = f"""WITH {DOC}, {CAPPED}, vd AS (SELECT symbol, seq, win, {REASON} AS why FROM sampled),
va AS (SELECT *, min(seq) OVER (PARTITION BY symbol, seq // 5) AS survivor FROM vd WHERE why IS NULL)
SELECT symbol, seq, win, 'dropped' AS state, why FROM vd WHERE why IS NOT NULL UNION ALL SELECT symbol, seq, win, 'kept', NULL FROM va WHERE seq = survivor
UNION ALL SELECT symbol, seq, win, 'merged', 'into ' || CAST(survivor AS VARCHAR) FROM va WHERE seq <> survivor"""
O["view_governance"] = f"""WITH RECURSIVE {EV}, {applied('ev', ad.EV_AS_OF, True)}
SELECT gt.symbol, gt.seq, gt.event_type, CASE WHEN ap.eff IS NOT NULL THEN 'penalised' WHEN gt.penalty IS NULL THEN gt.bucket WHEN gt.historical THEN 'out of window' ELSE 'counted once' END AS state, gt.penalty, ap.eff
FROM gt LEFT JOIN ap ON gt.symbol = ap.symbol AND gt.seq = ap.seq"""
O["view_actions"] = f"""WITH {ACT}, {unique('act')}, {scored('uq', ad.ACT_AS_OF)} SELECT symbol, seq, CASE WHEN substance = 'passing' THEN 'passing' WHEN tracked_only THEN 'tracked' WHEN gate_b THEN 'quarantined' ELSE 'scored' END AS state,
CAST(pts AS DOUBLE) AS severity_points, stage, score, direction, gate_a FROM sc"""
O["view_coverage"] = f"""WITH {DOC}, {CAPPED}, vd AS (SELECT symbol, {REASON} AS why FROM sampled), h AS (SELECT DISTINCT symbol FROM doc),
vc AS (SELECT h.symbol, count(vd.symbol) FILTER (why IS NULL) AS kept, count(why) AS dropped FROM h LEFT JOIN vd ON h.symbol = vd.symbol GROUP BY h.symbol)
SELECT symbol, kept, dropped FROM vc UNION ALL SELECT 'PORTFOLIO', CAST(sum(kept) AS BIGINT), CAST(sum(dropped) AS BIGINT) FROM vc"""
BALANCE = """bl AS (SELECT symbol, avg(CASE WHEN sentiment > 0 THEN 1.0 ELSE 0.0 END) AS positive_share, count(*) AS n FROM terms WHERE counted AND sentiment <> 0 GROUP BY symbol),
bn AS (SELECT *, CASE WHEN positive_share >= 0.75 THEN 'clearly positive' WHEN positive_share >= 0.58 THEN 'mostly positive' WHEN positive_share >= 0.42 THEN 'balanced' WHEN positive_share >= 0.25 THEN 'mostly negative' ELSE 'clearly negative' END AS balance FROM bl)"""
O["view_balance"] = f"WITH {ORD}, {TERMS}, {BALANCE} SELECT symbol, round(positive_share, 6) AS positive_share, n, balance FROM bn"
FIELD = lambda name, c, text=True: f"""CASE WHEN {c} IS NULL THEN NULL ELSE '"{name}":' || {f"to_json({c})" if text else f"CAST({c} AS VARCHAR)"} END"""
O["view_payload"] = f"""WITH RECURSIVE {PORTFOLIO}, {TERMS}, {BALANCE}, sd AS (SELECT *, CASE WHEN push > 0 THEN 'up' ELSE 'down' END AS side FROM terms WHERE counted AND push <> 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY abs(push) DESC, seq) AS rank FROM sd QUALIFY rank <= 3),
dj AS (SELECT symbol, '"drivers":[' || string_agg('{{"side":"' || side || '","rank":' || rank || ',"event_type":"' || event_type || '","sentiment":' || sentiment || ',"push":"' || printf('%.4f', push) || '"}}', ',' ORDER BY side, rank) || ']' AS drivers FROM dr GROUP BY symbol),
pj AS (SELECT pf.symbol, '{{' || concat_ws(',', {FIELD('symbol', 'pf.symbol')}, {FIELD('sentiment_band', 'sentiment_band', False)}, {FIELD('governance_label', 'governance_label')}, {FIELD('risk_band', 'risk_band')}, {FIELD('balance', 'balance')}, drivers) || '}}' AS payload
  FROM pf LEFT JOIN dj ON pf.symbol = dj.symbol LEFT JOIN bn ON pf.symbol = bn.symbol) SELECT symbol, payload, sha256(payload) AS payload_hash FROM pj"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


NAMES = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(c)}" for k, c in ft.NAMED.items()) + "}"
CONTROLS = "MAP {" + ", ".join(f"{k}: {quoted(c)}" for k, c in ft.WINDOWS.items()) + "}"


def plain(x: str) -> str:
    """Tags out, entities decoded part by part, white space in single spaces."""
    number = "(CASE WHEN regexp_matches(e, '^&#[xX]') THEN CAST('0x' || regexp_extract(e, '[0-9a-fA-F]+', 0) AS BIGINT) ELSE CAST(regexp_extract(e, '[0-9]+', 0) AS BIGINT) END)"
    told = f"CASE WHEN {number} = 0 OR {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {number} BETWEEN 128 AND 159 THEN coalesce({CONTROLS}[{number}], '') ELSE chr(CAST({number} AS INT)) END"
    value = f"coalesce(CASE WHEN starts_with(e, '&#') THEN {told} ELSE {NAMES}[e[2:-2]] END, e)"
    bare = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    parts = f"string_split_regex(t, '{ft.ENTITY}')"
    found = f"list_concat([''], list_transform(regexp_extract_all(t, '{ft.ENTITY}'), lambda e: {value}))"
    return f"trim(regexp_replace(list_transform([{bare}], lambda t: array_to_string(list_transform(list_zip({found}, {parts}), lambda z: z[1] || z[2]), ''))[1], '{ft.SPACE}', ' ', 'g'))"


BARE = "h"
for _tag in ft.ASIDE:
    BARE = f"regexp_replace({BARE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
SCRIPTS = f"list_transform(list_filter(regexp_extract_all(h, {quoted(ft.SCRIPT)}, 1), lambda x: json_valid(x)), lambda x: CAST(x AS JSON))"
OBJECTS = "CASE WHEN json_type(x) = 'ARRAY' THEN CAST(x AS JSON[]) WHEN json_type(x, '$.\"@graph\"') = 'ARRAY' THEN CAST(json_extract(x, '$.\"@graph\"') AS JSON[]) ELSE [x] END"
LINKED = f"list_filter(list_transform(flatten(list_transform({SCRIPTS}, lambda x: {OBJECTS})), lambda o: json_extract_string(o, '$.articleBody')), lambda y: length(y) > 200)[1]"
ABOUT = f"coalesce(nullif(regexp_extract(h, {quoted(ft.ABOUT[0])}, 1), ''), regexp_extract(h, {quoted(ft.ABOUT[1])}, 1))"
O["fulltext_extract"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CASE WHEN contains(h, 'ld+json') THEN {LINKED} END AS body, {plain(ABOUT)} AS about, list_transform(regexp_extract_all({BARE}, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {plain('x')}) AS ps FROM p),
r AS (SELECT page_id, body, about, list_filter(ps, lambda x: length(x) > 70 AND NOT regexp_matches(x, {quoted(ft.JUNK)}) AND x <> about) AS kept FROM q)
SELECT page_id, coalesce(substr({plain('body')}, 1, 4000), CASE WHEN coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) > 250
  THEN CASE WHEN length(about) > 80 THEN about || ' ' ELSE '' END || substr(array_to_string(kept, ' '), 1, 4000) WHEN length(about) > 80 THEN substr(about, 1, 4000) ELSE '' END) AS text FROM r"""


def doubles(sql: str) -> str:
    """Decimal literals outside quotes as doubles, which is what Spark computes with here."""
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x) for x in parts[::2]]
    return "'".join(parts)


ORACLES = {name: doubles(sql) for name, sql in O.items()}
