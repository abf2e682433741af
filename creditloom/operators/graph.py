"""Relationship tables around each company: promoters, subsidiaries, partners, agencies, lenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import has_any, round_to, squeeze
from creditloom.operators.ledger import first_n

# Name rules, organisation patterns, agency names, link weights and caps.
MONTH_YEAR = r"^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{4}$"
DAY_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
UNIT_WORDS = r"\b(?:crore|lakh|lakhs|million|mn)\b"
BAD_WORDS = ["raid", "raids", "fraud", "scam", "insolvency", "arbitration", "case"]
ORGANISATION = r"\b([A-Z][A-Za-z0-9&.,()\- ]{2,90}(?:Pvt\.?\s*Ltd\.?|Private Limited|Limited|Ltd\.?|LLP|FZE|GmbH))\b"
PARTNER_ORGANISATION = (
    r"\b([A-Z][A-Za-z0-9&.,()\- ]{2,90}(?:Corporation|Corp\.?|Inc\.?|Ltd\.?|Limited|Pvt\.?\s*Ltd\.?|LLP|FZE|GmbH|Bank|Trust))\b"
)
RELATION_WORDS = ["subsidiary", "associate", "group company", "joint venture", "wholly owned"]
ENTITY_HINTS = ["gmbh", "fze", "pvt ltd", "limited", "llp"]
PARTNER_WORDS = ["strategic", "partnership", "collaboration", "mou", "alliance"]
AGENCIES = [
    ("crisil", "CRISIL Ratings"), ("icra", "ICRA"), ("care", "CARE Ratings"), ("fitch", "Fitch Ratings"), ("moodys", "Moody's"), ("moody's", "Moody's"),
]


def valid_entity(name: Column, company: Column) -> Column:
    cleaned = F.regexp_replace(squeeze(name), r"^[ \-,:;.]+|[ \-,:;.]+$", "")
    low = F.lower(cleaned)
    return (
        (F.char_length(cleaned) >= 3)
        & (low != F.lower(F.trim(company)))
        & ~low.rlike(MONTH_YEAR) & ~low.rlike(DAY_DATE) & ~low.rlike(r"^(?:rs |rs\.|₹)") & ~low.rlike(UNIT_WORDS)
        & ~has_any(low, BAD_WORDS) & cleaned.rlike("[a-zA-Z]")
    )


def _names(companies: DataFrame) -> DataFrame:
    return companies.select("company_id", "company_name")


def _first_per_name(rows: DataFrame, order: list[str], keep: list[str], cap: int | None) -> DataFrame:
    """First row per company and lower-cased name, numbered in order."""
    at = F.struct(*order)
    unique = rows.groupBy("company_id", F.lower("name").alias("name_key")).agg(F.min(at).alias("at"), F.min_by(F.struct("name", *keep), at).alias("r"))
    return first_n(unique, ["company_id"], [F.col("at")], cap).select("company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "r.*")


def promoters(companies: DataFrame, holders: DataFrame, holding: DataFrame, cap: int | None = None) -> DataFrame:
    """Listed shareholders; else the promoter group if its holding is known; else the named managers.

    `holders`: company_id, doc_id, pos, name, pct; `holding`: company_id, promoter_holding_pct, promoter_pledge_pct;
    companies carry managers: array<string>.
    """
    names = _names(companies)
    pledge = holding.select("company_id", F.col("promoter_pledge_pct").alias("pledge_pct"))
    listed_raw = holders.join(names, "company_id").filter(valid_entity(F.col("name"), F.col("company_name")))
    unique = listed_raw.groupBy("company_id", F.lower("name").alias("name_key")).agg(
        F.max_by(F.struct("name", F.col("pct").alias("holding_pct")), F.struct("pct", -F.col("doc_id"), -F.col("pos"))).alias("r"))
    listed = first_n(unique.select("company_id", "r.*"), ["company_id"], [F.col("holding_pct").desc(), F.col("name")], cap).join(pledge, "company_id", "left").select(
        "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "name", "holding_pct", F.coalesce("pledge_pct", F.lit(0.0)).alias("pledge_pct"))
    found = listed.select("company_id").distinct()
    group = names.join(found, "company_id", "left_anti").join(holding, "company_id").filter(F.col("promoter_holding_pct").isNotNull()).select(
        "company_id", F.lit(1).cast("bigint").alias("rank_no"), F.lit("Promoter Group").alias("name"),
        F.col("promoter_holding_pct").alias("holding_pct"), F.col("promoter_pledge_pct").alias("pledge_pct"))
    rest = companies.join(found, "company_id", "left_anti").join(group.select("company_id"), "company_id", "left_anti")
    named = managers(rest).join(names, "company_id").filter(valid_entity(F.col("name"), F.col("company_name")))
    people = first_n(named, ["company_id"], [F.col("seq")], cap).select(
        "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "name", F.lit(0.0).alias("holding_pct"), F.lit(0.0).alias("pledge_pct"))
    return listed.unionByName(group).unionByName(people)


def managers(companies: DataFrame) -> DataFrame:
    """Named managers, blanks dropped, in their order."""
    kept = F.filter(F.transform("managers", lambda m: F.trim(m)), lambda m: m != "")
    return companies.select("company_id", F.posexplode(kept).alias("pos", "name")).select("company_id", (F.col("pos") + 1).cast("bigint").alias("seq"), "name")


def _organisations(companies: DataFrame, sentences: DataFrame, pattern: str) -> DataFrame:
    found = sentences.select("company_id", "doc_id", "pos", F.lower("sentence").alias("low"), F.posexplode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1))).alias("hit", "raw"))
    named = found.withColumn("name", squeeze(F.col("raw")))
    return named.join(_names(companies), "company_id").filter(valid_entity(F.col("name"), F.col("company_name")))


def subsidiaries(companies: DataFrame, sentences: DataFrame, cap: int | None = None) -> DataFrame:
    """Organisations in related-party sentences. `sentences`: company_id, doc_id, pos, sentence."""
    low = F.lower("sentence")
    hits = _organisations(companies, sentences.filter(has_any(low, RELATION_WORDS + ENTITY_HINTS)), ORGANISATION)
    kind = F.when(F.contains("low", F.lit("associate")), "Associate").when(F.contains("low", F.lit("joint venture")), "Joint Venture").otherwise("Subsidiary")
    return _first_per_name(hits.withColumn("relationship", kind), ["doc_id", "pos", "hit"], ["relationship"], cap)


def partners(companies: DataFrame, sentences: DataFrame, cap: int | None = None) -> DataFrame:
    hits = _organisations(companies, sentences.filter(has_any(F.lower("sentence"), PARTNER_WORDS)), PARTNER_ORGANISATION)
    return _first_per_name(hits.withColumn("relationship", F.lit("Strategic Partner")), ["doc_id", "pos", "hit"], ["relationship"], cap)


def agencies(companies: DataFrame, sentences: DataFrame, cap: int | None = None) -> DataFrame:
    low = F.lower("sentence")
    tokens = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(label)) for w, label in AGENCIES]))
    hits = sentences.select("company_id", "doc_id", "pos", F.posexplode(tokens).alias("hit", "name")).join(_names(companies), "company_id")
    valid = hits.filter(valid_entity(F.col("name"), F.col("company_name"))).withColumn("relationship", F.lit("Rating Agency"))
    return _first_per_name(valid, ["doc_id", "pos", "hit"], ["relationship"], cap)


def lenders(companies: DataFrame, limits: DataFrame, cap: int | None = None) -> DataFrame:
    """`limits`: company_id, doc_id, pos, lender, limit_amount."""
    amount = F.coalesce("limit_amount", F.lit(0.0))
    rows = limits.select(
        "company_id", "doc_id", "pos", F.trim("lender").alias("name"),
        F.when(amount > 1e5, round_to(amount / 1e7, 2)).otherwise(round_to(amount, 2)).alias("amount_cr")).join(_names(companies), "company_id")
    return _first_per_name(rows.filter(valid_entity(F.col("name"), F.col("company_name"))), ["doc_id", "pos"], ["amount_cr"], cap)


def _members(promoter_rows: DataFrame, subsidiary_rows: DataFrame, lender_rows: DataFrame, partner_rows: DataFrame, agency_rows: DataFrame) -> DataFrame:
    one = lambda c, n: F.format_string(f"%.{n}f", round_to(c, n))
    shape = lambda df, prefix, weight, risk, label: df.select(
        "company_id", F.concat(F.lit(prefix + "_"), (F.col("rank_no") - 1).cast("string")).alias("node_id"), "name",
        risk.alias("risk"), F.lit(weight).cast("bigint").alias("weight"), label.alias("label"))
    low = F.lit("LOW")
    pledge = F.when(F.col("pledge_pct") > 75, "HIGH").when(F.col("pledge_pct") > 25, "MEDIUM").otherwise("LOW")
    parts = [
        shape(promoter_rows, "promoter", 20, pledge, F.concat(one(F.col("holding_pct"), 1), F.lit("% holding"))),
        shape(subsidiary_rows, "sub", 18, low, F.col("relationship")),
        shape(lender_rows, "lender", 16, low, F.concat(F.lit("₹"), one(F.col("amount_cr"), 2), F.lit(" Cr charge"))),
        shape(partner_rows, "partner", 14, low, F.col("relationship")),
        shape(agency_rows, "rating", 12, low, F.col("relationship")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_nodes(companies: DataFrame, members: DataFrame) -> DataFrame:
    main = companies.select("company_id", F.lit("main").alias("node_id"), F.col("company_name").alias("label"), F.lit("company").alias("node_type"), F.lit("LOW").alias("risk"))
    return main.unionByName(members.select("company_id", "node_id", F.col("name").alias("label"), F.lit("counterparty").alias("node_type"), "risk"))


def graph_links(members: DataFrame) -> DataFrame:
    return members.select("company_id", F.lit("main").alias("source"), F.col("node_id").alias("target"), "weight", F.col("risk").alias("confidence"), "label")


def graph_counts(companies: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("company_id").agg(F.count("*").alias("n"))
    links = F.coalesce("n", F.lit(0)).cast("bigint")
    return companies.select("company_id").join(n, "company_id", "left").select("company_id", (links + 1).alias("entity_count"), links.alias("connection_count"))


members = _members
