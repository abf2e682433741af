"""Text jobs over a documents table (doc_id, company_id, doc_text) and a pages table.

All of them are row-local array and regex expressions, so they run in the scan stage; only the
holder list needs a shuffle, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.text import all_matches, first_item, holding, lines_of, number_text, sentences_with, unescape
from creditloom.functions.values import clip, has_any, mentions, present, rlike_first, round_to, squeeze

# Patterns, words, limits and confidences.
NUM = r"([\d,]+(?:\.\d+)?)"
UNITS = r"(crores?|cr|lakhs?|lacs?|million|mn)"
REVENUE_CRORE = r"[Rr]evenue[\s\S]{0,160}?₹\s*" + NUM + r"\s*(?:[Cc]r(?:ores?)?)\b"
REVENUE_LAKH = r"[Rr]evenue[^0-9]{0,80}" + NUM + r"\s*[Ll]akhs?\b"
GROSS_RECEIPTS = r"[Gg]ross\s+[Rr]eceipts[^0-9]*" + NUM
REVENUE_SERIES = [
    r"(?i)revenue(?: from operations)?[\s\S]{0,120}?₹\s*" + NUM + r"\s*(crores?|cr)?",
    r"(?i)revenue(?: from operations)?[\s\S]{0,120}?" + NUM + r"\s*" + UNITS + "?",
    r"(?i)annual turnover[^\d]{0,40}" + NUM + r"\s*" + UNITS + "?",
    r"(?i)gross receipts[^\d]{0,40}" + NUM + r"\s*" + UNITS + "?",
]
PROFIT_SERIES = [r"(?i)(?:pat|profit after tax|net profit)[^\d]{0,30}" + NUM + r"\s*" + UNITS + "?"]
ANY_MONEY = r"(?i)(?:revenue|receipts|turnover|debt)[^\d]{0,40}" + NUM + r"\s*" + UNITS + "?"
CIN = r"(?i)\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"
PAN = r"(?i)\b([A-Z]{5}[0-9]{4}[A-Z])\b"
NAME_SUFFIX = r"(?i)([A-Z][A-Za-z0-9&.,\-\s]{3,80}(?:Pvt\.?\s*Ltd\.?|Limited|LLP))"
NAME_LABEL = r"(?i)name of the company[:\s]+([A-Za-z0-9&.,\-\s]{4,100})"
TOTAL_DEBT = r"(?i)(?:total debt|borrowings)[^\d]{0,20}" + NUM
CONCENTRATION = r"(?i)(?:top\s*5\s*customers?|customer concentration(?:\s*risk)?)[^\d%]{0,40}(\d{1,3}(?:\.\d+)?)\s*%"
RATING_ACTION = r"(?i)\b(upgraded|downgraded|reaffirmed|assigned)\b"
RATING_GRADE = r"(?i)(?:crisil|icra|care(?:\s+ratings)?)[\s\S]{0,60}?\b([A-Z]{1,4}[+-]?)\b"
PARTNER = r"(?i)(?:strategic partner(?:ship)?|collaboration|alliance|mou)[\s\S]{0,80}?\b([A-Z][A-Za-z0-9&.,()\- ]{2,80})\b"
BANK_LIMIT = r"(?i)([A-Za-z&\s]{3,40}bank)[^\d]{0,20}" + NUM
DISPUTE_WORDS = ["court", "petition", "litigation", "notice", "dispute"]
RELATED_WORDS = [
    "related party", "subsidiary", "associate", "joint venture", "wholly owned", "strategic partner",
    "strategic partnership", "collaboration", "alliance", "mou", "rating agency", "rated by", "crisil",
    "icra", "care ratings", "fitch", "moody",
]
AUDITOR_WORDS = ["qualified opinion", "emphasis of matter", "material uncertainty", "adverse opinion", "disclaimer"]
AUDITOR_PATTERN = "(?i)(" + "|".join(AUDITOR_WORDS) + ")"
COLLATERAL_WORDS = ["collateral", "security", "hypothecation"]
CONTENT_WORDS = {
    "ANNUAL_REPORT": ["directors' report", "board of directors", "standalone financial"],
    "SANCTION_LETTER": ["sanctioned amount", "rate of interest", "security"],
    "LEGAL_NOTICE": ["cause of action", "legal notice", "advocate"],
    "RATING_REPORT": ["crisil", "icra", "care ratings", "credit rating"],
    "FINANCIAL_STATEMENT": ["balance sheet", "profit & loss", "cash flow"],
    "BOARD_MINUTES": ["minutes of meeting", "resolution passed", "quorum"],
}
#: In lower case, what a text must hold for the patterns above to match.
REVENUE_WORDS = [["revenue"], ["revenue"], ["annual turnover"], ["gross receipts"]]
PROFIT_WORDS = [["pat", "profit after tax", "net profit"]]
DEBT_WORDS = ["total debt", "borrowings"]
CUSTOMER_WORDS, ACTION_WORDS, GRADE_WORDS = ["customer"], ["graded", "reaffirmed", "assigned"], ["crisil", "icra", "care"]
PARTNER_WORDS = ["strategic partner", "collaboration", "alliance", "mou"]
CIN_DIGITS, PAN_DIGITS = "[0-9]{5}[A-Za-z]{2}[0-9]{4}", "[0-9]{4}[A-Za-z]"
PERCENT = r"(\d{1,2}(?:\.\d{1,2})?)\s*%"
NOT_HOLDERS = ["category", "shareholding", "promoter holding", "public holding", "total"]
PROMOTER_NAMES = ["promoter", "family trust", "holdings"]
PAGE_RULES = [
    (r"\bed raid\b|\bcbi\b|\bsfio\b|\bgst fraud\b|\bfake invoice\b", "FRAUD_ALERT", "CRITICAL", -24.0),
    (r"\bnclt\b|\binsolvency\b|\bcirp\b|\bliquidation\b", "LITIGATION", "CRITICAL", -22.0),
    (r"\bdefault\b|\bnpa\b|\bcheque bounce\b", "FRAUD_ALERT", "HIGH", -14.0),
    (r"\bcourt\b|\blawsuit\b|\barbitration\b|\bdrt\b", "LITIGATION", "MEDIUM", -7.0),
    (r"\brbi\b|\bsebi\b|\bfssai\b|\bregulatory\b", "REGULATORY_ACTION", "MEDIUM", -6.0),
    (r"\bgrowth\b|\bexpansion\b|\baward\b|\bstrong demand\b", "COMPANY_NEWS", "LOW", 2.0),
]
DROPPED_TAGS = ["script", "style", "nav", "footer", "header", "aside"]

TEXT = "doc_text"


def crore_value(number: Column, unit: Column) -> Column:
    """Amount in crore; without a unit the size decides. Unreadable numbers count as zero."""
    value, low = number_text(F.regexp_replace(number, "₹", "")), F.lower(F.coalesce(unit, F.lit("")))
    has = lambda *words: has_any(low, words)
    return F.coalesce(
        F.when(has("lakh", "lac"), value / 100.0)
        .when(has("million", "mn"), value / 10.0)
        .when(has("crore") | low.startswith("cr") | F.contains(low, F.lit(" cr")), value)
        .when(value > 100000, value / 100.0)
        .when(value > 10000, value / 10.0)
        .otherwise(value),
        F.lit(0.0),
    )


def revenue_crore(text: Column, low: Column | None = None) -> Column:
    revenue = holding(text, ["revenue"], low)
    return F.coalesce(
        number_text(rlike_first(revenue, REVENUE_CRORE)),
        number_text(rlike_first(revenue, REVENUE_LAKH)) / 100.0,
        number_text(rlike_first(holding(text, ["receipts"], low), GROSS_RECEIPTS)),
    )


def revenues(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", revenue_crore(F.col(TEXT)).alias("revenue_cr"))


def unit_values(docs: DataFrame) -> DataFrame:
    """First amount after a money word, in crore."""
    number, unit = rlike_first(F.col(TEXT), ANY_MONEY, 1), rlike_first(F.col(TEXT), ANY_MONEY, 2)
    return docs.select("doc_id", number.alias("raw_number"), unit.alias("unit"), crore_value(number, unit).alias("crore")).filter("raw_number IS NOT NULL")


def money_series(text: Column, patterns: list[str], words: list[list[str]] | None = None, low: Column | None = None) -> Column:
    """The amounts of each pattern, labelled by their place; zero amounts drop out. `words`: per pattern, what `holding` looks for."""
    found = []
    for p, w in zip(patterns, words or [[]] * len(patterns), strict=True):
        found.append(F.transform(all_matches(holding(text, w, low) if w else text, p), lambda x, i: F.struct(
            round_to(crore_value(x["first"], x["second"]), 2).alias("amount"), F.concat(F.lit("annual_"), (i + 1).cast("string")).alias("period"))))
    return F.filter(F.concat(*found), lambda x: x["amount"] > 0)


def money_rows(docs: DataFrame) -> DataFrame:
    both = F.concat(
        F.transform(money_series(F.col(TEXT), REVENUE_SERIES), lambda x: F.struct(F.lit("revenue").alias("kind"), x["amount"].alias("amount"), x["period"].alias("period"))),
        F.transform(money_series(F.col(TEXT), PROFIT_SERIES), lambda x: F.struct(F.lit("profit").alias("kind"), x["amount"].alias("amount"), x["period"].alias("period"))),
    )
    return docs.select("doc_id", F.posexplode(both).alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "x.kind", "x.amount", "x.period", F.lit(0.72).alias("confidence"))


def first_identifier(text: Column, pattern: str, digits: str) -> Column:
    """First hit of an identifier's pattern; `digits` is a part of it that begins with a figure and so rules most texts out quickly."""
    return rlike_first(F.when(text.rlike(digits), text), pattern)


def identifiers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", first_identifier(F.col(TEXT), CIN, CIN_DIGITS).alias("cin"), first_identifier(F.col(TEXT), PAN, PAN_DIGITS).alias("pan"))


def company_name(text: Column) -> Column:
    """Name before the first legal suffix, else after its label.

    The suffix pattern tries every letter of a text as a start. A name is at most 81 characters
    before its suffix, so the pattern is tried around the first suffix, and on the whole text
    only when that one carries no name.
    """
    at = F.regexp_instr(text, F.lit("(?i)Pvt|Limited|LLP"))
    ahead = F.least(at - 1, F.lit(81))
    near = F.substring(text, at - ahead, ahead + 200)
    around = F.nullif(F.regexp_extract(near, r"(?i)^[\s\S]{0,77}?" + NAME_SUFFIX[4:], 1), F.lit(""))
    by_suffix = F.when(at > 0, F.coalesce(around, rlike_first(text, NAME_SUFFIX)))
    by_label = F.when(text.rlike("(?i)name of the company"), rlike_first(text, NAME_LABEL))
    return squeeze(F.coalesce(by_suffix, by_label))


def total_debt(text: Column, low: Column | None = None) -> Column:
    return number_text(rlike_first(holding(text, DEBT_WORDS, low), TOTAL_DEBT))


def rating_columns(text: Column, low: Column | None = None) -> list[Column]:
    first = lambda words, pattern: rlike_first(holding(text, words, low), pattern)
    return [
        first(CUSTOMER_WORDS, CONCENTRATION).try_cast("double").alias("concentration_pct"),
        F.upper(first(ACTION_WORDS, RATING_ACTION)).alias("rating_action"),
        F.upper(first(GRADE_WORDS, RATING_GRADE)).alias("rating_grade"),
        squeeze(first(PARTNER_WORDS, PARTNER)).alias("partner"),
    ]


def rating_facts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *rating_columns(F.col(TEXT)))


def bank_limits(text: Column, low: Column | None = None) -> Column:
    held = F.when(text.rlike("(?i)bank") if low is None else F.contains(low, F.lit("bank")), text).otherwise("")
    pairs = F.transform(F.regexp_extract_all(held, F.lit(BANK_LIMIT), F.lit(0)), lambda m: F.struct(
        squeeze(F.regexp_extract(m, BANK_LIMIT, 1)).alias("lender"), number_text(F.regexp_extract(m, BANK_LIMIT, 2)).alias("limit_amount")))
    return F.filter(pairs, lambda x: x["limit_amount"].isNotNull())


def bank_limit_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(bank_limits(F.col(TEXT))).alias("pos", "x")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "x.lender", "x.limit_amount", F.lit("Working Capital").alias("facility_type"), F.lit(0.7).alias("confidence"))


def disputes(text: Column, low: Column | None = None) -> Column:
    return F.filter(sentences_with(text, DISPUTE_WORDS, low=low), lambda s: F.char_length(s) >= 20)


def related_parties(text: Column, low: Column | None = None) -> Column:
    found = F.filter(sentences_with(text, RELATED_WORDS, low=low), lambda s: s != "")
    return F.array_distinct(found)


def auditor_notes(text: Column, low: Column | None = None) -> Column:
    return F.filter(sentences_with(text, AUDITOR_WORDS, AUDITOR_PATTERN, low), lambda s: s != "")


def collateral_lines(text: Column, low: Column | None = None) -> Column:
    held = F.when(mentions(text, COLLATERAL_WORDS), text).otherwise("") if low is None else F.coalesce(holding(text, COLLATERAL_WORDS, low), F.lit(""))
    lines = F.filter(F.split(held, "\n"), lambda s: mentions(s, COLLATERAL_WORDS))
    return F.filter(F.transform(lines, squeeze), lambda s: F.char_length(s) > 12)


def exploded(docs: DataFrame, items: Column, name: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(items).alias("pos", name)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), name)


def going_concern(text: Column, guard: bool = False) -> Column:
    """Any mention counts; with the guard on, a mention right after a negation does not."""
    hit = text.rlike("(?i)going concern")
    return hit & ~text.rlike(r"(?i)\b(?:no|not any|without)\s+going concern") if guard else hit


def content_type(text: Column, low: Column | None = None) -> Column:
    """Type with the most of its words in the text; the first declared wins ties."""
    low = F.lower(text) if low is None else low
    scores = []
    for i, (name, words) in enumerate(CONTENT_WORDS.items()):
        n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        scores.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit("UNKNOWN").alias("name"))
    return F.array_max(F.array(*scores, none))["name"]


def facts(docs: DataFrame, source_confidence: Column | float = 0.9) -> DataFrame:
    """One row per document with every extracted field. A text is lowered once, and patterns are tried only where it holds what they begin with or need."""
    text, low = F.col(TEXT), F.col("low")
    base = docs.withColumn("low", F.lower(text)).select(
        "doc_id", "company_id",
        first_identifier(text, CIN, CIN_DIGITS).alias("cin"), first_identifier(text, PAN, PAN_DIGITS).alias("pan"),
        revenue_crore(text, low).alias("revenue_cr"),
        money_series(text, REVENUE_SERIES, REVENUE_WORDS, low).alias("revenue_series"), money_series(text, PROFIT_SERIES, PROFIT_WORDS, low).alias("profit_series"),
        total_debt(text, low).alias("total_debt"), bank_limits(text, low).alias("bank_limits"), disputes(text, low).alias("disputes"),
        related_parties(text, low).alias("related_parties"), auditor_notes(text, low).alias("auditor_notes"), collateral_lines(text, low).alias("collateral"),
        (F.contains(low, F.lit("going concern")) & going_concern(text)).alias("going_concern"), content_type(text, low).alias("content_type"),
        (F.lit(source_confidence) if isinstance(source_confidence, float) else source_confidence).alias("source_confidence"),
        *rating_columns(text, low),
    )
    has_revenue = F.coalesce(F.col("revenue_cr") > 0, F.lit(False)) | (F.size("revenue_series") > 0)
    step = lambda cond, v: F.when(cond, v).otherwise(0.0)
    own = round_to(F.least(
        F.lit(0.55) + step(F.col("cin").isNotNull(), 0.05) + step(F.col("pan").isNotNull(), 0.05) + step(has_revenue, 0.1)
        + step(F.size("profit_series") > 0, 0.1) + step(F.col("content_type") != "UNKNOWN", 0.1), F.lit(0.95)), 3)
    confidence = clip((own + F.col("source_confidence")) / 2, 0.1, 1.0)
    return base.withColumn("confidence", round_to(confidence, 6)).withColumn("needs_review", F.col("confidence") < 0.7)


def confidence_rows(docs: DataFrame) -> DataFrame:
    f = facts(docs, F.when(F.char_length(TEXT) >= 120, 0.9).otherwise(0.45))
    notes = present([
        (F.col("needs_review"), F.lit("Low extraction confidence (<0.7). Manual credit analyst review required.")),
        (F.size("auditor_notes") > 0, F.lit("CRITICAL: Auditor qualifications present in submitted document.")),
        (F.col("going_concern"), F.lit("CRITICAL: Going concern doubt observed in auditor commentary.")),
    ])
    return f.select("doc_id", "confidence", "needs_review", F.array_join(notes, " | ").alias("risk_notes"))


def holders(docs: DataFrame) -> DataFrame:
    """Shareholders named on lines with a percentage; the first line per name counts."""
    lines = F.filter(lines_of(F.col(TEXT)), lambda s: F.contains(s, F.lit("%")))
    at = docs.select("doc_id", "company_id", F.posexplode(lines).alias("pos", "line"))
    before = F.regexp_extract("line", "^(.*?)" + PERCENT, 1)
    bare = F.regexp_replace(before, r"^[ \-:|]+|[ \-:|]+$", "")
    name = F.regexp_replace(F.trim(F.regexp_replace(bare, r"^\d+\s*[\).:-]\s*", "")), r"\s{2,}", " ")
    rows = at.select("doc_id", "company_id", "pos", name.alias("name"), rlike_first(F.col("line"), PERCENT).try_cast("double").alias("pct"))
    kept = rows.filter((F.col("pct") > 0) & (F.char_length("name") >= 3) & ~has_any(F.lower("name"), NOT_HOLDERS))
    return kept.groupBy("doc_id", "company_id", F.lower("name").alias("name_key")).agg(
        F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), round_to(F.min_by("pct", "pos"), 2).alias("pct")
    )


def top_holders(docs: DataFrame, n: int | None = None) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("pct").desc(), F.col("pos"))
    ranked = holders(docs).withColumn("rank_no", F.row_number().over(w).cast("bigint")).select("doc_id", "company_id", "rank_no", "name", "pct")
    return ranked if n is None else ranked.filter(F.col("rank_no") <= n)


def _line_percent(lines: Column, word: str) -> Column:
    hits = F.filter(lines, lambda s: F.contains(F.lower(s), F.lit(word)) & s.rlike(PERCENT))
    return round_to(rlike_first(first_item(hits), PERCENT).try_cast("double"), 2)


def holding_facts(docs: DataFrame) -> DataFrame:
    """Promoter holding and pledge per document with the flags; the holder list is the fallback."""
    lines = lines_of(F.col(TEXT))
    stated = docs.select("doc_id", "company_id", _line_percent(lines, "promoter").alias("stated"), _line_percent(lines, "pledge").alias("pledged"))
    listed = holders(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_holders"),
        F.sum(F.when(has_any(F.col("name_key"), PROMOTER_NAMES), F.col("pct").cast("decimal(9,2)"))).cast("double").alias("listed"),
    )
    held = F.coalesce("stated", "listed", F.lit(0.0))
    text = lambda label, c: F.concat(F.lit(label), F.format_string("%.2f", c), F.lit("%"))
    flags = present([
        (F.col("pledged") > 25, text("Promoter pledge is high at ", F.col("pledged"))),
        (held < 26, text("Promoter holding is low at ", held)),
    ])
    return stated.join(listed, "doc_id", "left").select(
        "doc_id", "company_id", held.alias("promoter_holding_pct"), F.coalesce("pledged", F.lit(0.0)).alias("pledged_pct"),
        F.array_join(flags, " | ").alias("red_flags"),
        F.coalesce("n_holders", F.lit(0)).alias("n_holders"),
        F.when(F.col("n_holders") > 0, 0.72).otherwise(0.35).alias("confidence"),
    )


def holding_company_name(text: Column) -> Column:
    return squeeze(first_item(F.filter(lines_of(text), lambda s: (F.char_length(s) <= 80) & has_any(F.lower(s), ["limited", "pvt", "llp"]))))


#: Ends of lines and blanks at their ends, as text libraries for pages know them.
LINE_ENDS = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
EDGE_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Elements whose content is no markup: they end at their closing tag or with the page, and do not nest.
RAW_TAGS = ("script", "style")


def without_element(html: Column, tag: str) -> Column:
    """`html` with every element of this name, what is in it and elements of the same name in it, replaced by a line end.

    Innermost elements go first, again until none is left; each pass reads the text once, and a page without nesting needs one. An element that is never closed
    stays, but for RAW_TAGS, where it reaches to the end of the page.
    """
    opens = rf"(?is)<{tag}(?:\s[^>]*)?>"
    if tag in RAW_TAGS:
        return F.regexp_replace(html, rf"{opens}.*?(?:</{tag}\s*>|\z)", "\n")
    innermost = rf"{opens}[^<]*+(?:<(?!/?{tag}[\s>])[^<]*+)*+</{tag}\s*>"
    once = F.regexp_replace(html, innermost, "\n")
    passes = F.sequence(F.lit(2), F.regexp_count(html, F.lit(opens)))
    start = F.struct(once.alias("text"), (once != html).alias("open"))

    def again(state: Column, _: Column) -> Column:
        shorter = F.when(state["open"], F.regexp_replace(state["text"], innermost, "\n")).otherwise(state["text"])
        return F.struct(shorter.alias("text"), (state["open"] & (shorter != state["text"])).alias("open"))

    return F.when(F.regexp_count(html, F.lit(opens)) < 2, once).otherwise(F.aggregate(passes, start, again, lambda state: state["text"]))


def _without(tag: str):
    return lambda html: without_element(html, tag)


def page_text(html: Column, max_chars: int | None = None) -> Column:
    """Visible text of a page, one text node per line; character references with a closing mark are decoded once, after the tags went."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED_TAGS:
        out = F.transform(F.array(out), _without(tag))[0]  # worked out once per tag
    out = F.transform(F.array(F.regexp_replace(out, r"<[^>]*>", "\n")), unescape)[0]
    trimmed = F.transform(F.split(out, LINE_ENDS), lambda x: F.regexp_replace(x, f"^{EDGE_BLANKS}|{EDGE_BLANKS}$", ""))
    joined = F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def headline(content: Column, fallback: Column) -> Column:
    lines = F.filter(lines_of(content), lambda s: F.char_length(s).between(15, 180))
    return F.coalesce(first_item(lines), fallback)


def source_name(url: Column) -> Column:
    """First label of the host in title case."""
    host = F.replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("www."), F.lit(""))
    label = F.split(host, r"\.")[0]
    titled = F.replace(F.initcap(F.replace(label, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))
    return F.when(host == "", "Web").otherwise(titled)


def rule_findings(content: Column) -> Column:
    """Rules that fire on the page text, as (type, severity, impact)."""
    low = F.lower(content)
    return present([(low.rlike(p), F.struct(F.lit(t).alias("finding_type"), F.lit(s).alias("severity"), F.lit(i).alias("score_impact"))) for p, t, s, i in PAGE_RULES])


def page_findings(pages: DataFrame) -> DataFrame:
    """`pages`: page_id, url, content, query."""
    return pages.select(
        "page_id", "url", "content", "query", F.posexplode(rule_findings(F.col("content"))).alias("pos", "hit")
    ).select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "hit.*",
        headline(F.col("content"), F.col("query")).alias("headline"),
        F.trim(F.replace("content", F.lit("\n"), F.lit(" "))).alias("summary"),
        source_name(F.col("url")).alias("source_name"),
        F.col("content").alias("raw_snippet"),
    )


def any_date(c: Column) -> Column:
    """Year-month-day, then day/month/year, then day-month-year."""
    parse = lambda shape, fmt: F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt)).cast("date"))
    return F.coalesce(
        parse(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), parse(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), parse(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"))
