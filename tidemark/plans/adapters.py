"""Views that give the test tables the shape of items, actions, prices and events.

Most are one SQL text that both Spark and the oracle's engine read; ``{orders}`` and the like stand for tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORD_AS_OF, ACT_AS_OF, EV_AS_OF, DOC_AS_OF = "2001-08-01", "2001-11-04", "2024-01-30", "2024-12-31"


def pick(expr: str, values: list) -> str:
    """A CASE that takes a value by the remainder of a whole number."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(values)) + " END"


#: Two runs that hold all rows between them; each has a symbol that the other lacks.
RUN_A = "(seq % 2 = 0 OR holding_seq = 5) AND holding_seq <> 6"
#: A run whose stored scores don't come out again for some symbols, and lack one.
RUN_AGAIN = "(holding_seq % 4 <> 1 OR seq % 2 = 0) AND holding_seq <> 7"
RUN_B = "(seq % 2 <> 0 OR seq % 3 <> 0 OR holding_seq = 6) AND holding_seq <> 5"

ORD_TYPES = ["earnings_beat", "earnings_miss", "order_win", "regulatory_action", "management_exit", "exchange_fine", "other", "guidance_change", "dividend", "price_move", "pledge", "dilution", "operating_update"]
TITLES = [
    "SEBI penalty order against the company", "Managing director to retire, successor named", "CFO resigns amid board dispute", "Customs duty hike hits sector",
    "Board appoints new chief executive officer", "Two arrested for fraud, bank defrauded", "Wins order worth Rs 250 crore", "Q1 net profit jumps 20%",
    "Auditor resigns citing delays", "Stocks to watch today", "Share price hits 52-week high", "Dividend of Rs 5 per share", "Vice president quits",
    "Compliance officer resigns with immediate effect", "New plant lifts capacity", "Regulator opens probe into pledge",
]
SUBJECTS = ["company", "company", "company", None, "victim", "subsidiary", "promoter_or_insider", "company", "macro_policy", "company", "company"]
STAGES = ["order_or_settlement", None, "notice_or_demand", "n/a", "resolved_or_quashed", "routine", "order_or_settlement"]
SEVERITIES = ["material", "integrity", None, "minor", "procedural"]
DIRECTIONS = ["unplanned_exit", None, "appointment", "unplanned_exit"]
TIERS = ["cxo_cs_cfo_compliance", None, "below_cxo"]
MATERIALITY = ["low", "medium", "high", None]

ORD = f"""
SELECT o.o_orderkey AS seq, n.n_name AS symbol, concat(n.n_name, ' Works') AS company, c.c_mktsegment AS sector, CAST(n.n_nationkey AS BIGINT) AS holding_seq, CAST(o.o_orderdate AS DATE) AS published, 'news' AS kind,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN -2 WHEN '2' THEN -1 WHEN '3' THEN 0 WHEN '4' THEN 1 ELSE 2 END AS sentiment,
  {pick("o.o_orderkey", ORD_TYPES)} AS event_type, {pick("o.o_orderkey", TITLES)} AS title, {pick("o.o_custkey", MATERIALITY)} AS materiality,
  {pick("o.o_orderkey", SUBJECTS)} AS subject, {pick("o.o_custkey", STAGES)} AS action_stage, {pick("o.o_orderkey", SEVERITIES)} AS severity,
  {pick("o.o_custkey", DIRECTIONS)} AS people_direction, {pick("o.o_orderkey", TIERS)} AS role_tier, 'stated by the source' AS rationale,
  {pick("o.o_orderkey", ["primary", "primary", "primary", "passing", None, "primary"])} AS substance, {pick("o.o_orderkey", ["news", "results", "filings"])} AS pass_,
  CASE WHEN o.o_orderkey % 50 = 0 THEN '' ELSE concat('https://example.org/a/', CAST(o.o_orderkey % 4001 AS VARCHAR(20))) END AS url,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE CAST(o.o_orderkey % 7 AS DOUBLE) / 8.0 + 0.25 END AS confidence, {pick("o.o_custkey", ["T1", "T2", "T3", "T4"])} AS max_tier,
  CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(o.o_orderkey % 40 AS DOUBLE) END AS amount_inr_cr, (o.o_orderkey % 13 = 4) AS historical,
  {pick("o.o_orderkey", ["key-one", None, None, None, "key-two", None, None])} AS event_key, (o.o_orderkey % 3 <> 1) AS governance_flag, (o.o_orderkey % 17 <> 3) AS occurred_at_company, CASE WHEN o.o_orderkey % 301 = 0 THEN CAST(-3.0 AS DOUBLE) END AS penalty_override
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
"""

ACT_TYPES = [
    "dividend", "pledge", "buyback", "merger_acquisition", "dilution", "management_exit", "split_bonus", "dividend", "auditor_resignation", "index_inclusion", "rights_issue",
    "lock_in_expiry", "open_offer_takeover", "admin_notice", "fy_end_change", "special_dividend", "routine_agm_egm", "capacity_expansion", "dividend", "demerger", "other", "pledge", "buyback",
]
ACT = f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS seq, l.l_partkey AS symbol, CAST(l.l_shipdate AS DATE) AS published, 'news' AS kind,
  CASE WHEN l.l_orderkey % 997 = 0 THEN 'insolvency_admission' ELSE {pick("l.l_orderkey + l.l_linenumber", ACT_TYPES)} END AS event_type,
  CASE l.l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 ELSE 0 END AS sentiment,
  concat('Rs ', CAST(CAST(l.l_quantity AS INT) % 4 AS VARCHAR(9)), CASE WHEN l.l_linenumber % 2 = 0 THEN ' per share declared' ELSE ', 1,200 crore in all' END) AS title,
  {pick("l.l_orderkey", ["board_approved", None, "board_intimation", "approval_obtained", "completed"])} AS ca_stage,
  CASE WHEN l.l_linenumber % 3 = 0 THEN l.l_discount * 100.0 END AS ca_size_pct, CASE WHEN l.l_orderkey % 3 = 0 THEN CAST(l.l_orderkey % 90 AS DOUBLE) END AS ca_days_to_effective,
  {pick("l.l_orderkey", MATERIALITY)} AS materiality, {pick("l.l_orderkey", SEVERITIES)} AS severity, {pick("l.l_orderkey", ["primary", None, "primary", "passing", "primary", "primary", "primary"])} AS substance
FROM {{lineitem}} l
"""

PRICE = """
SELECT l_partkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity * (1.0 + l_discount)) AS close FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)
"""

EV_TYPES = ["regulatory_action", "management_exit", "investigation", "exchange_fine", "board_independence", "pledge", "earnings_beat", "rpt_concern"]
EV = f"""
SELECT event_id AS seq, concat('U', CAST(user_id AS VARCHAR(20))) AS symbol, CAST(ts AS DATE) AS published, CAST(ts AS DATE) AS event_date, 'news' AS kind,
  {pick("event_id", EV_TYPES)} AS event_type, CASE WHEN event_type = 'error' THEN 'CFO resigns amid dispute' ELSE {pick("event_id", TITLES)} END AS title,
  'stated by the source' AS rationale, {pick("event_id", MATERIALITY)} AS materiality, 'company' AS subject, {pick("user_id", SEVERITIES)} AS severity,
  {pick("event_id", STAGES)} AS action_stage, 'unplanned_exit' AS people_direction, 'cxo_cs_cfo_compliance' AS role_tier, CAST(NULL AS DOUBLE) AS amount_inr_cr,
  TRUE AS occurred_at_company, (event_type <> 'view') AS governance_flag, (event_id % 5 = 2) AS historical, CASE WHEN event_id % 211 = 0 THEN CAST(-4.0 AS DOUBLE) END AS penalty_override,
  {pick("event_id", ["key-one", None, None, "key-two", None])} AS event_key, {pick("event_id", ["T1", "T2", "T3"])} AS max_tier, {pick("event_id", ["sentiment", "governance"])} AS purpose,
  CAST(event_id % 5 AS INT) - 2 AS sentiment, concat('https://', {pick("event_id", ["reuters.com", "example.org", "news.example.net", "example.org", "livemint.com"])}, '/e/', CAST(event_id % 5003 AS VARCHAR(20))) AS url, {pick("user_id", ["Penalty Order Works", None, "Board Compliance Stores", "Fraud Detection", None])} AS company, CAST(event_id % 4 AS INT) AS run
FROM {{events}}
"""

DOC_SPARK = """
SELECT d.doc_id AS seq, d.lang AS symbol, d.source AS source, array_join(slice(split(d.text, ' '), 1, 12), ' ') AS title, d.text AS snippet,
  concat('https://www.', d.source, '.example.org/', CAST(d.doc_id % 701 AS VARCHAR(20)), CASE WHEN d.doc_id % 2 = 0 THEN '/' ELSE '' END) AS url,
  DATE '2024-12-31' - CAST((d.doc_id * 37) % 400 AS INT) AS published, CAST(d.n_chars % 5 AS INT) AS relevance, (d.doc_id % 6 <> 5) AS usable,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN TRUE ELSE FALSE END AS governance_flag, 'news' AS kind
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
DOC_DUCK = DOC_SPARK.replace("array_join(slice(split(d.text, ' '), 1, 12), ' ')", "array_to_string(string_split(d.text, ' ')[1:12], ' ')")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(text: str) -> str:
    return text.format(**{t: t for t in TABLES})
