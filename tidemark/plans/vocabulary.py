"""Word lists, patterns and domain tiers, which must equal the published ones for right results."""

from __future__ import annotations

CLUSTER_STOP = (
    "the a an and or of to in on for at by with from as is are was were be its it this that has have had will says said say new over "
    "after amid into up down vs via per than about share shares stock stocks ltd limited india indian co company news today live update "
    "updates here what why how know key top latest report reports crore cr rs lakh pc yoy qoq fy q1 q2 q3 q4 inc plc nse bse"
).split()

EVENT_STOP = (
    "over with from that this into after have will been company limited india indian news issues announces says report reports notice "
    "probe begins launches"
).split()

GENERIC_NAME_WORDS = (
    "india indian ltd limited company co corp corporation industries industry the and of bank laboratories pharma pharmaceuticals motors "
    "finance financial technologies engineering asset management services small forgings precision automation life power"
).split()

BOILERPLATE = (
    r"share price (today|live|update)", r"stock price (today|live)", r"\bbuy,? sell or hold\b", r"should you (buy|sell|hold)",
    r"stocks? to (watch|buy|track)( today)?", r"top (stocks|picks|gainers|losers)", r"live updates?", r"\bin focus\b", r"shares? in (focus|news)",
    r"record date (today|alert|tomorrow)", r"ex-?dividend (today|date alert)", r"technical (view|analysis|chart)",
    r"\bintraday\b", r"52-week (high|low)", r"market (wrap|highlights|roundup)",
    r"\bF&O\b", r"\bweekly wrap\b", r"(nifty|sensex) (today|ends|opens|closes)",
    r"last day to buy", r"\bex-?date\b", r"dividends?: ", r"brand film", r"hosts? (a |an )?(delegation|summit|conclave|webinar)",
    r"stocks? (rally|surge|jump|fall|drop|slip|crash)e?s? \d+%", r"shares? (jump|rise|gain|fall|slip|drop|tank|surge)s? \d+%",
    r"stocks? in (news|action)",
)

PRICE_LANGUAGE = (
    r"52[- ]?week (high|low)",
    r"\b(share|stock)s? (price )?(rose|fell|slipped|jumped|surged|slumped|tumbled|gained|dropped|climbed|slid|hit)\b",
    r"\bsell[- ]?off\b", r"\bfifth straight gain\b", r"\b(all[- ]time|record|multi-year) (high|low)\b", r"\bshare price\b",
    r"\bthe stock (rose|fell|slipped|gained|dropped)\b", r"\b\d+(\.\d+)?% (rally|slide|fall|jump|drop|decline|gain) in (the )?(share|stock)",
    r"\bupper circuit\b", r"\blower circuit\b", r"\bmarket cap(italisation)? (rose|fell|crossed)\b",
)

FUNDAMENTAL = (
    r"result|profit|\bpat\b|revenue|earnings|guidance|order|dividend|buy-?back|bonus|upgrade|downgrade|target|rating|"
    r"capex|expansion|acquisition|merger|approval|launch|contract|sebi|rbi|penalt|probe|resign|appoint"
)

GOV_TITLE = (
    r"resign|quits?|steps? down|stepped down|terminat|appoint|elevat|promot|\bcfo\b|\bceo\b|\bmd\b|chief|company secretary|"
    r"compliance|sebi|\brbi\b|penalt|\bfine[ds]?\b|show.cause|settle|probe|investigat|raid|\bcbi\b|\bed\b|nclt|auditor|"
    r"related.party|independent director|\bboard\b|pledge|whistle|fraud|default|forensic|exchange|order|ban(ned)?\b|suspend|"
    r"demand notice|show cause|nppa|fssai|usfda|drug regulator|embezzl|postal ballot"
)

FUND_TITLE = (
    r"result|net profit|\bpat\b|profit (rises|jumps|falls|drops|surges|declines|up|down)|revenue|earnings|\bq[1-4]\b|quarter|"
    r"guidance|outlook|order (win|book|inflow)|orders?\b|margin|ebitda|dividend|capex|market share|volume|sales"
)

FILING_DOMAINS = ("bseindia.com", "nseindia.com", "sebi.gov.in", "rbi.org.in", "mca.gov.in", "cci.gov.in")
PR_DOMAINS = ("prnewswire.com", "businesswire.com", "globenewswire.com", "einpresswire.com", "accesswire.com")
PRESS_DOMAINS = (
    "reuters.com", "bloomberg.com", "economictimes.indiatimes.com", "business-standard.com", "livemint.com", "moneycontrol.com",
    "thehindubusinessline.com", "financialexpress.com", "ndtvprofit.com", "cnbctv18.com", "thehindu.com", "indianexpress.com",
    "hindustantimes.com", "ft.com", "wsj.com", "timesofindia.indiatimes.com",
)

STYLES = (
    ("exchange-filing", r"regulation 30|disclosure under|outcome of board meeting|intimation (of|to)|sebi (order|settlement)|filing with (bse|nse)|stock exchange (filing|disclosure)"),
    ("press-release", r"press release|\bannounces\b.*\b(launch|partnership|appointment)|\bpr newswire\b"),
    ("market-roundup", r"\bsensex\b|\bnifty\b|stocks? to (watch|buy)|top (gainers|losers)|market (wrap|close|update)|stocks? in news|buzzing|stock market today|closing bell|opening bell|shares? (in focus|to watch)"),
    ("broker-note", r"target price|price target|\bupgrades?\b|\bdowngrades?\b|initiates? coverage|\b(buy|sell|hold|accumulate|outperform|overweight|underweight) (rating|call)\b|maintains? (buy|sell|hold)|brokerage|analysts? (say|see|expect)|motilal|jefferies|nomura|kotak institutional|icici securities|jm financial|cll?sa|goldman sachs|morgan stanley"),
    ("results", r"\bq[1-4]\b|quarterly (results|earnings)|net profit|\bpat\b|revenue (rises|jumps|falls|up|down)|earnings|\bresults?\b|profit (rises|jumps|falls|drops|surges|declines)|\bebitda\b|order book"),
    ("corporate-action", r"dividend|buy-?back|\bbonus\b|stock split|rights issue|\bqip\b|acquisition|acquires|merger|demerger|delist"),
    ("opinion-feature", r"\bopinion\b|editorial|\banalysis\b|explained|\bwhy\b|what (next|it means)|column|deep dive"),
)

#: Keyword labels in order: pattern, event type, sentiment, governance flag.
LABEL_RULES = (
    (r"sebi|regulator|rbi (penalt|order)|penalty|settlement order", "regulatory_action", -2, True),
    (r"investigat|probe|raid|show[- ]cause", "investigation", -1, True),
    (r"auditor.*(resign)", "auditor_resignation", -2, True),
    (r"restate|restatement|qualified opinion", "auditor_restatement", -2, True),
    (r"exchange fine|fined by (bse|nse)|disclosure lapse", "exchange_fine", -1, True),
    (r"independent director|board independence|combined (roles|chair)", "board_independence", -1, True),
    (r"pledge", "pledge", -1, True),
    (r"related[- ]party", "rpt_concern", -1, True),
    (r"(chief|cfo|ceo|\bmd\b|managing director|company secretary|compliance officer).{0,60}(resign|quits?|steps? down|exit|terminat)|(resign|quits?|steps? down|terminat).{0,60}(chief|cfo|ceo|\bmd\b|managing director|company secretary|compliance officer)", "management_exit", -1, True),
    (r"appointed|appoints|elevat|promot|re-?designat|superannuat|retire|takes? charge|named (as )?head", "management_change_routine", 0, True),
    (r"resign|steps? down|quits?", "management_change_routine", 0, True),
    (r"lawsuit|litigation|court", "litigation", -1, True),
    (r"beat|record profit|profit (up|jumps|rises)", "earnings_beat", 2, False),
    (r"miss|profit (falls|drops|declines)|loss widens", "earnings_miss", -2, False),
    (r"guidance", "guidance_change", 0, False),
    (r"order win|bags order|wins order|contract", "order_win", 1, False),
    (r"capacity|new plant|expansion", "capacity_expansion", 1, False),
    (r"upgrade|target price|downgrade", "analyst_action", 0, False),
    (r"client base|business update|record .*book|yoy", "operating_update", 2, False),
    (r"buyback", "buyback", 1, False),
    (r"dividend", "dividend", 1, False),
    (r"rights issue|qip|preferential|dilution", "dilution", -1, False),
    (r"acquisition|acquires|merger", "merger_acquisition", 1, False),
)

# Patterns of the verification gate. The word "hire" is matched as a word here.
EXIT_WORDS = r"resign|quit|steps? down|stepped down|exit|terminat|sacked|removed|ousted|abrupt|dismiss|relieved|fired"
BENIGN_PEOPLE = (
    r"elevat|promot|re-?designat|appointed as|appoints|appointment of|named (as )?(the )?head|takes? charge|assum(es|ed) charge|superannuat|"
    r"retire|retirement|succession|completion of (his|her|the) (term|tenure)|transition|move[sd]? to|to head|new role|additional charge|"
    r"appointed|reappoint|\bhires?\b|\bhired\b|incoming|joins as|succe(ed|ssor)"
)
C_SUITE = (
    r"\b(ceo|cfo|cto|coo|cio|cmo|cpo|md|chief [a-z&/ ,-]{2,40} officer|chief executive|managing director|company secretary|compliance officer)\b"
)
ORDERLY = (
    r"((to|will|set to) (step down|retire|exit|leave|move on|hand over)|succession|transition|succeeded by|successor|to take over|takes? over as|"
    r"named (as )?(new|next)|to be replaced|replaced by|appointed (as )?(new|next|his|her))"
)
ABRUPT = r"abrupt|immediate effect|with immediate|sudden|terminat|sacked|removed|ousted|dismiss|fired|quits|resigns? (amid|after|over|following)"
RETIRED = r"superannuat|retire|completion of (his|her|the) (term|tenure)"
NOT_RETIRED = r"resign|terminat|abrupt|sudden"
MACRO = (
    r"customs duty|import duty|duty hike|gst (rate|council|cut|hike)|union budget|\bbudget\b|tariff|rbi (repo|rate)|monetary policy|sector[- ]wide|"
    r"industry[- ]wide|all (companies|manufacturers|banks)|new rules? for|tightens? (rules|norms)|(rules|norms) (tightened|tighten)|cough[- ]syrup"
)
NAMED_ORDER = r"\b(sebi|rbi|nse|bse|order|penalt|fined?|settle)"
VICTIM = (
    r"(arrest|booked|held|nabbed).{0,60}(cheat|defraud|fraud).{0,60}\b(bank|company)\b|\bbank (was )?(cheated|defrauded)|"
    r"appraisers? (arrested|cheat)"
)

GATE_ENUMS = {
    "subject": ("company", "subsidiary", "promoter_or_insider", "victim", "lender_or_counterparty", "peer_or_sector", "macro_policy", "shareholders", "other"),
    "action_stage": ("order_or_settlement", "notice_or_demand", "investigation", "resolved_or_quashed", "routine", "n/a"),
    "severity": ("integrity", "material", "minor", "procedural", "immaterial", "n/a"),
    "people_direction": ("unplanned_exit", "planned_exit_or_succession", "appointment", "promotion_or_elevation", "reappointment", "n/a"),
    "role_tier": ("cxo_cs_cfo_compliance", "senior_management", "below_cxo", "non_executive_director", "n/a"),
}
STAGED_TYPES = ("regulatory_action", "investigation", "exchange_fine", "rpt_concern", "litigation")
PEOPLE_TYPES = ("management_exit", "management_change_routine")

_T1 = "bseindia.com nseindia.com sebi.gov.in rbi.org.in reuters.com ptinews.com bloomberg.com aninews.in"
_T2 = (
    "economictimes.indiatimes.com livemint.com business-standard.com moneycontrol.com thehindubusinessline.com financialexpress.com "
    "cnbctv18.com ndtvprofit.com thehindu.com businesstoday.in ndtv.com hindustantimes.com indianexpress.com telegraphindia.com "
    "deccanherald.com newindianexpress.com zeebiz.com timesofindia.indiatimes.com business-standard.in fortuneindia.com outlookbusiness.com"
)
_T4 = (
    "marketscreener.com tipranks.com simplywall.st investing.com equitymaster.com stocktwits.com 5paisa.com indiainfoline.com goodreturns.in "
    "marketsmojo.com trendlyne.com tickertape.in chartink.com business-upturn.com lokmattimes.com thehansindia.com mangalorean.com "
    "sarkaritel.com bizzbuzz.news pressreleasepoint.com einnews.com prnewswire.com businesswire.com globenewswire.com newsvoir.com msn.com "
    "yahoo.com flipboard.com"
)
DOMAIN_TIERS = {d: t for t, names in (("T1", _T1), ("T2", _T2), ("T4", _T4)) for d in names.split()}
