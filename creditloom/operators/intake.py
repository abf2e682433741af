"""Document intake: classification by name, content and sheets, routing, review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import ends_with_any, has_any

# File-name words per class (in order of precedence), upload lists, sheet words.
NAME_RULES = [
    ("ALM", ["alm", "asset_liab", "assetliab", "liquidity", "maturity_profile", "maturity_bucket"]),
    ("SHAREHOLDING", ["shareholding", "share_pattern", "sharehol", "promoter_holding", "sh_pattern"]),
    ("BORROWING_PROFILE", ["borrowing", "debt_schedule", "credit_profile", "loan_profile", "borrowal", "facility_list", "credit_facilities"]),
    ("ANNUAL_REPORT", [
        "annual_report", "annual report", "p&l", "profit_loss", "balance_sheet", "cashflow", "financial_statement", "_ar_",
        "fy20", "fy21", "fy22", "fy23", "fy24", "fy25", "ar_fy", "annual",
    ]),
    ("PORTFOLIO", ["portfolio", "performance", "aum", "npa_report", "collection", "disbursement", "portfolio_cut", "fund_performance", "port_cut"]),
]
BOOK_NAME_RULES = [
    ("financial_statement", ["financial_statement", "financial", "fs_", "key_credit"]),
    ("gst_returns", ["gst", "gstr", "gst_return"]),
    ("bank_statement", ["bank_statement", "bank_stmt", "bank statement"]),
    ("shareholding", ["shareholding", "share_holding", "promoter"]),
]
BOOK_SHEET_RULES = [
    ("gst_returns", ["recon", "gstr", "gst"]),
    ("financial_statement", ["p&l", "balance", "ratio"]),
    ("shareholding", ["shareholding", "promoter"]),
]
CLASS_ROUTES = {
    "ALM_STATEMENT": "alm", "ALM": "alm", "SHAREHOLDING": "shareholding", "SHAREHOLDING_PATTERN": "shareholding",
    "BORROWING_PROFILE": "borrowing", "BORROWING": "borrowing", "PORTFOLIO": "portfolio", "PORTFOLIO_QUALITY": "portfolio",
}
TEXT_EXTENSIONS = [".pdf", ".docx", ".jpg", ".jpeg", ".png"]
BOOK_EXTENSIONS = [".csv", ".xlsx", ".xls"]
ALLOWED_MIME = [
    "application/pdf", "text/csv", "application/json", "application/xml", "text/xml", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/jpeg", "image/jpg", "image/png",
]
ALLOWED_EXTENSIONS = [".pdf", ".csv", ".json", ".xml", ".xls", ".xlsx", ".docx", ".jpg", ".jpeg", ".png"]
MAX_BYTES = 50 * 1024 * 1024


def _first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return F.coalesce(*[F.when(has_any(text, words), F.lit(name)) for name, words in rules])


def name_class(files: DataFrame) -> DataFrame:
    """Class from the file name; spaces, dashes and dots count as underscores."""
    normal = F.regexp_replace(F.lower("file_name"), r"[\s\-\.]", "_")
    hit = _first_rule(normal, NAME_RULES)
    return files.select(
        "doc_id", "file_name", F.coalesce(hit, F.lit("ANNUAL_REPORT")).alias("auto_type"), F.when(hit.isNotNull(), 0.92).otherwise(0.40).alias("confidence"))


def book_type(files: DataFrame, sheets: DataFrame) -> DataFrame:
    """Workbook type from the file name, else from its sheet names, else a bank statement.

    `files`: file_name; `sheets`: file_name, sheet.
    """
    low = F.lower("sheet")
    by_file = sheets.groupBy("file_name").agg(*[F.bool_or(has_any(low, words)).alias(f"has_{name}") for name, words in BOOK_SHEET_RULES])
    by_sheet = F.coalesce(*[F.when(F.col(f"has_{name}"), F.lit(name)) for name, _ in BOOK_SHEET_RULES])
    return files.join(by_file, "file_name", "left").select(
        "file_name", F.coalesce(_first_rule(F.lower("file_name"), BOOK_NAME_RULES), by_sheet, F.lit("bank_statement")).alias("book_type"))


def effective_class(reviews: DataFrame) -> DataFrame:
    """The reviewer's class wins over the automatic one."""
    return reviews.withColumn("effective_type", F.coalesce(F.nullif("human_override", F.lit("")), F.col("auto_type")))


def route(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """Processing route per document: by effective class first, then by extension and name."""
    joined = files.join(effective_class(reviews).select("doc_id", "effective_type"), "doc_id", "left")
    low = F.lower("file_name")
    by_class = F.coalesce(*[F.when(F.upper("effective_type") == k, F.lit(v)) for k, v in CLASS_ROUTES.items()])
    structured = ends_with_any(low, [".json", ".xml"])
    by_name = (
        F.when(ends_with_any(low, TEXT_EXTENSIONS), "text")
        .when(structured & F.contains(low, F.lit("gstr")), "tax_return")
        .when(structured & F.contains(low, F.lit("itr")), "income_tax_return")
        .when(structured, "unrouted")
        .when(ends_with_any(low, BOOK_EXTENSIONS), F.coalesce(_first_rule(low, BOOK_NAME_RULES), F.lit("bank_statement")))
        .otherwise("unrouted")
    )
    return joined.select("doc_id", "company_id", "file_name", "effective_type", F.coalesce(by_class, by_name).alias("route"))


def right_company(identifiers: DataFrame, companies: DataFrame) -> DataFrame:
    """Drops documents whose CIN contradicts the company's. `identifiers`: doc_id, company_id, cin."""
    own = companies.select("company_id", F.upper(F.trim("cin")).alias("own_cin"))
    found = F.upper(F.trim(F.coalesce("cin", F.lit(""))))
    wrong = (found != "") & (F.coalesce("own_cin", F.lit("")) != "") & (found != F.col("own_cin"))
    return identifiers.join(own, "company_id", "left").filter(~wrong).select("doc_id", "company_id", "cin")


def upload_check(files: DataFrame) -> DataFrame:
    """Accepted or not, with the reason."""
    listed = F.col("mime_type").isin(ALLOWED_MIME) | ends_with_any(F.lower("file_name"), ALLOWED_EXTENSIONS)
    reason = F.when(~listed, "type not allowed").when(F.col("size_bytes") > MAX_BYTES, "too large")
    return files.select("doc_id", "file_name", reason.isNull().alias("accepted"), reason.alias("reject_reason"))


def listed_documents(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents with their classification, also those not classified yet."""
    own = effective_class(reviews).select("doc_id", "auto_type", "effective_type", "human_approved")
    return files.select("doc_id", "company_id", "file_name").join(own, "doc_id", "left")


def not_rejected(reviews: DataFrame) -> DataFrame:
    """Approved and pending classifications with their status."""
    return effective_class(reviews).filter(F.col("human_approved").isNull() | F.col("human_approved")).select(
        "doc_id", "company_id", "effective_type", F.when(F.col("human_approved"), "APPROVED").otherwise("PENDING").alias("status"))


def review_summary(reviews: DataFrame) -> DataFrame:
    state = F.col("human_approved")
    return reviews.groupBy("company_id").agg(
        F.count("*").alias("total"),
        F.count_if(state).alias("approved"),
        F.count_if(state.isNull()).alias("pending"),
        F.count_if(~state).alias("rejected"),
        (F.count_if(state.isNull()) == 0).alias("all_reviewed"),
    )
