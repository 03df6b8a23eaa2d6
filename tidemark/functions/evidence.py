"""Source tiers, evidence factors, claim fields and verdict checks as column expressions.

Lexicons are matched at word bounds by default; `mode="reference"` matches substrings, traps included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of source tiers by domain, tried from tier 1 to 4.
TIERS = {
    "government": {1: [r"\.gov$", r"\.gov\.", r"europa\.eu", r"\.gov\.uk", r"nic\.in", r"\.gob\."], 2: [r"\.org$", r"reuters\.com", r"apnews\.com", r"bloomberg\.com"], 3: [r"\.com$", r"\.net$"], 4: [r"reddit\.com", r"x\.com", r"twitter\.com", r"medium\.com", r"quora\.com"]},
    "corporate": {1: [r"sec\.gov", r"investor\.", r"ir\.", r"/investor-relations", r"companieshouse"], 2: [r"reuters\.com", r"bloomberg\.com", r"ft\.com", r"wsj\.com"], 3: [r"techcrunch\.com", r"\.com$"], 4: [r"reddit\.com", r"x\.com", r"blogspot\."]},
    "science": {1: [r"arxiv\.org", r"doi\.org", r"nature\.com", r"science\.org", r"pubmed", r"\.edu$"], 2: [r"nih\.gov", r"who\.int", r"\.ac\."], 3: [r"sciencedaily", r"newscientist"], 4: [r"reddit\.com", r"substack\."]},
    "software": {1: [r"status\.", r"statuspage\.io", r"github\.com/[^/]+/[^/]+/releases", r"/docs/"], 2: [r"github\.com", r"stackoverflow\.com"], 3: [r"medium\.com", r"dev\.to"], 4: [r"reddit\.com", r"x\.com"]},
}
# Weight of a source by its tier; weights of the factors of support.
TIER_PRIOR = {1: 1.0, 2: 0.78, 3: 0.5, 4: 0.2}
FACTOR_WEIGHTS = {"authority": 0.20, "recency": 0.12, "independence": 0.22, "directness": 0.14, "specificity": 0.08, "agreement": 0.16, "validity": 0.08}
# Phrases of second-hand reports; what counts as specific.
SECONDHAND = r"(?i)\b(according to|as reported by|cited by|per a report|sources say|reportedly|a spokesperson (?:said|told))\b"
SPECIFIC = r"(?i)(\d{4}-\d{2}-\d{2}|\b\d[\d,]*\.?\d*\s?(?:%|billion|million)|\bQ[1-4]\s?\d{4})"

# Attribute lexicon in order of precedence, hedges, opinions, numbers.
ATTRIBUTES = {
    "ceo": ("ceo", "chief executive"),
    "cto": ("cto", "chief technology officer"),
    "cfo": ("cfo", "chief financial officer"),
    "revenue": ("revenue", "sales", "turnover", "top line"),
    "net_income": ("net income", "net profit", "net earnings", "netincomeloss"),
    "profit": ("profit", "earnings", "operating income"),
    "headcount": ("headcount", "employees", "staff", "workforce"),
    "status": ("status", "state", "phase", "stage", "construction", "operational", "commissioned", "under way", "underway", "completed", "approved", "cancelled", "suspended", "delayed", "launched"),
    "valuation": ("valuation", "valued at", "market cap"),
    "headquarters": ("headquarters", "hq", "based in", "headquartered"),
    "price": ("price", "share price", "stock price"),
    "funding": ("funding", "raised", "round", "series"),
}
HEDGE = r"(?i)\b(may|might|could|reportedly|allegedly|expected to|plans to|is likely|rumou?red|appears|seems|suggests|potentially|possibly)\b"
OPINION = r"(?i)\b(believe|think|feel|arguably|remarkable|impressive|bold|disappointing|best|worst|should|ought)\b"
NUMBER = r"(?i)([$€£¥])?\s?(\d[\d,]*\.?\d*)\s?(billion|million|bn|m|k|%|percent)?"
NEGATION = r"(?i)\b(not|no longer|never|denied|denies|rejected|declined|failed to|without|ceased|stopped|cancell?ed|withdrew|refuted)\b"
ROUNDING = r"(?i)\b(about|approximately|roughly|around|nearly|over|under|~)\b"
SCOPE = r"(?i)\b(segment|division|subsidiary|region|excluding|including|adjusted|pro forma|constant currency|per share|q[1-4]|fiscal|calendar)\b"
# Words without content.
CONTENT_STOP = "a an the of and or to in on at for is are was were be by with as that this it its from".split()


def tier(source: Column, domain: str = "government", overrides: dict[str, int] | None = None) -> Column:
    """1 (primary) to 4; the first tier of which a pattern is found counts, 3 if none is.  `overrides` fix single sources."""
    s, out = F.lower(source), F.lit(3)
    for t in (4, 3, 2, 1):
        out = F.when(s.rlike("|".join(TIERS[domain][t])), F.lit(t)).otherwise(out)
    return reduce(lambda o, name: F.when(s == name.lower(), F.lit(overrides[name])).otherwise(o), overrides or {}, out)


def authority(source: Column, domain: str = "government", overrides: dict[str, int] | None = None) -> Column:
    t = tier(source, domain, overrides)
    return reduce(lambda out, k: F.when(t == k, TIER_PRIOR[k]).otherwise(out), TIER_PRIOR, F.lit(0.4))


def independence(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(6))) * 0.4 + F.least(F.lit(1.0), n / 3) * 0.6)


def directness(text: Column) -> Column:
    return F.when(text.rlike(SECONDHAND), 0.45).otherwise(1.0)


def specificity(text: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + 0.3 * F.size(F.regexp_extract_all(text, F.lit(SPECIFIC), F.lit(0))))


def support_label(score: Column, n: Column, conflict: Column) -> Column:
    return F.when(conflict, "CONFLICTED").when((n == 0) | (score < 0.25), "INSUFFICIENT").when((score >= 0.72) & (n >= 2), "HIGH").when(score >= 0.45, "MODERATE").otherwise("LOW")


def evidence_score(factors: dict[str, Column], n: Column) -> Column:
    total = reduce(lambda a, b: a + b, [factors[k] * w for k, w in FACTOR_WEIGHTS.items()])
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def attribute(text: Column, mode: str = "words") -> Column:
    """Canonical attribute a text names first in the lexicon's order; empty without one."""
    out = F.lit("")
    for name, words in reversed(ATTRIBUTES.items()):
        pattern = "|".join(words) if mode == "reference" else r"\b(" + "|".join(words) + r")\b"
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    every = "|".join(w for words in ATTRIBUTES.values() for w in words)
    return F.when(F.lower(text).rlike(every if mode == "reference" else rf"\b(?:{every})\b"), out).otherwise("")  # most texts name none


def number(text: Column) -> Column:
    """First number with its multiplier applied, percent as it stands; null without one."""
    value = F.replace(F.regexp_extract(text, NUMBER, 2), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, NUMBER, 3))
    scale = F.when(unit.isin("billion", "bn"), 1e9).when(unit.isin("million", "m"), 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return F.when(text.rlike("[0-9]"), value * scale)


def unit(text: Column) -> Column:
    u = F.lower(F.regexp_extract(text, NUMBER, 3))
    found = F.when(u.isin("%", "percent"), "%").otherwise(F.regexp_extract(text, NUMBER, 1))
    return F.when(~text.rlike("[0-9]"), "").otherwise(found)  # most texts have no number


def hedged(text: Column) -> Column:
    return text.rlike(HEDGE)


def checkable(text: Column) -> Column:
    return ~text.rlike(OPINION)


def content_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(CONTENT_STOP) & (F.length(w) > 1)))


def coverage(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of the claim's content words that the evidence has."""
    return F.when(F.size(claim_tokens) == 0, 0.0).otherwise(F.size(F.array_intersect(claim_tokens, evidence_tokens)) / F.size(claim_tokens))


def differ(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) > tolerance


def values_differ(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Null when two values can't be compared."""
    from tidemark.functions.text import norm_value

    x, y = norm_value(a), norm_value(b)
    return F.when(number(a).isNotNull() & number(b).isNotNull(), differ(number(a), number(b), tolerance)).when((x == "") | (y == ""), F.lit(None)).otherwise(x != y)


def polarity_conflict(a: Column, b: Column, covered: Column) -> Column:
    return (a.rlike(NEGATION) != b.rlike(NEGATION)) & (covered >= 0.5)
