"""Workbook jobs over the long cells table: company_id, file_name, sheet, row_idx, col_idx, cell_text.

Sheets of a file are taken in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import cell_number, has_any, rlike_first, round_to

SHEET = ["company_id", "file_name", "sheet_no", "sheet"]

# Sheet-name words per class, and the label words per figure of each class.
SHEET_CLASSES = {
    "ratios": ["ratio", "key credit", "financial ratio"],
    "profit": ["p&l", "profit", "income", "statement of profit"],
    "balance": ["balance sheet", "bs", "financial position"],
}
LABELS = {
    "ratios": {
        "interest_coverage": ["interest coverage", "ebitda/interest", "ebitda / interest", "icr"],
        "stated_dscr": ["dscr", "debt service coverage", "debt service"],
        "stated_de": ["debt equity", "debt-equity", "debt / equity", "d/e ratio", "debt to equity"],
        "current_ratio": ["current ratio"],
        "ebitda_margin": ["ebitda margin"],
    },
    "profit": {
        "ebitda": ["ebitda", "operating profit before", "earnings before interest"],
        "finance_cost": ["finance cost", "finance charges", "interest expense", "interest cost"],
        "revenue": ["revenue from operations", "total revenue", "net revenue", "gross revenue"],
        "profit_after_tax": ["profit after tax", "pat", "net profit", "profit for the year"],
    },
    "balance": {
        "stated_debt": ["total borrowings", "total debt", "long term borrowings", "long-term borrowings"],
        "stated_equity": ["total equity", "net worth", "shareholders equity", "shareholder's equity"],
        "share_capital": [
            "equity share capital", "paid-up equity share capital", "paid up equity share capital",
            "paid-up share capital", "paid up share capital", "share capital", "equity capital",
        ],
        "reserves": ["other equity", "reserves and surplus", "reserves & surplus", "total reserves", "retained earnings"],
        "long_borrowings": ["long term borrowings", "long-term borrowings", "non current borrowings", "non-current borrowings"],
        "short_borrowings": ["short term borrowings", "short-term borrowings", "current borrowings", "working capital borrowings"],
        "current_assets": ["total current assets", "current assets"],
        "current_liabilities": ["total current liabilities", "current liabilities"],
        "current_maturities": ["current portion of long-term", "current maturities of long-term", "cpltd"],
        "contingent": ["contingent liabilities", "contingent liability"],
    },
}
RECON_SHEETS = ["recon", "2a", "reconciliation", "2a vs 3b", "3b vs 2a"]
RECON_LABELS = {
    "itc_available": ["itc available per gstr-2a", "itc available per gstr 2a", "total itc available", "available itc"],
    "itc_claimed": ["itc claimed in gstr-3b", "itc claimed in gstr 3b", "total itc claimed", "itc claimed"],
    "itc_excess": ["excess itc claimed", "excess itc", "itc difference", "3b - 2a"],
    "stated_mismatch": ["mismatch as %", "mismatch %", "itc gap %", "gap percentage"],
}
MONTHLY_SHEETS = ["3b monthly", "gstr-3b", "monthly", "gstr3b"]
MONTH_HEADERS = ["month", "period", "filing period"]
LOOK_AHEAD = 4

FIGURES = [m for rules in LABELS.values() for m in rules]


def value_columns(cells: DataFrame) -> DataFrame:
    """Per sheet the column of the newest year in row 1; the leftmost on ties, 2 without a year."""
    year = rlike_first(F.col("cell_text"), r"(?:FY)?(\d{4})").try_cast("int")
    header = (F.col("row_idx") == 1) & (F.col("col_idx") >= 2) & (year > 0)
    newest = F.max_by("col_idx", F.when(header, F.struct(year, -F.col("col_idx"))))
    return cells.groupBy(*SHEET).agg(F.coalesce(newest, F.lit(2)).alias("value_col"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One record per sheet row: its label and its cells right of it, in column order. A record is as wide as a workbook's row."""
    return (
        cells.groupBy(*SHEET, "row_idx")
        .agg(
            F.max(F.when(F.col("col_idx") == 1, F.lower(F.trim("cell_text")))).alias("label"),
            F.array_sort(
                F.collect_list(
                    F.when(F.col("col_idx") > 1, F.struct("col_idx", cell_number(F.col("cell_text"), None).alias("num")))
                )
            ).alias("values"),
        )
        .filter(F.col("label").isNotNull())
    )


def _value_at(values: Column, value_col: Column) -> Column:
    near = F.filter(values, lambda v: v["col_idx"].between(value_col, value_col + LOOK_AHEAD) & (v["num"] != 0))
    stated = F.filter(values, lambda v: v["col_idx"] == value_col)
    return F.coalesce(F.get(near, 0)["num"], F.get(stated, 0)["num"], F.lit(0.0))


def label_values(rows: DataFrame, columns: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Per sheet and figure the value of the first row whose label holds one of the words."""
    hits = F.array_compact(F.array(*[F.when(has_any(F.col("label"), words), F.lit(m)) for m, words in rules.items()]))
    return (
        rows.withColumn("figure", F.explode(hits))
        .join(columns, SHEET)
        .groupBy(*SHEET, "figure")
        .agg(F.min_by(_value_at(F.col("values"), F.col("value_col")), "row_idx").alias("value"))
    )


def in_class(*names: str) -> Column:
    """Whether the sheet's name holds a word of one of the classes."""
    return has_any(F.lower("sheet"), [w for n in names for w in SHEET_CLASSES[n]])


def statement_values(cells: DataFrame) -> DataFrame:
    """All statement figures in long form, each looked up in the sheets of its class only."""
    cells = cells.filter(in_class(*LABELS))
    rows, columns = sheet_rows(cells), value_columns(cells)
    hits = []
    for name, rules in LABELS.items():
        hits += [F.when(in_class(name) & has_any(F.col("label"), words), F.lit(m)) for m, words in rules.items()]
    return (
        rows.withColumn("figure", F.explode(F.array_compact(F.array(*hits))))
        .join(columns, SHEET)
        .groupBy(*SHEET, "figure")
        .agg(F.min_by(_value_at(F.col("values"), F.col("value_col")), "row_idx").alias("value"))
    )


def statement_figures(cells: DataFrame) -> DataFrame:
    """Wide figures per workbook; a later sheet overwrites an earlier one."""
    return (
        statement_values(cells)
        .groupBy("company_id", "file_name")
        .pivot("figure", FIGURES)
        .agg(F.max_by("value", "sheet_no"))
    )


def leverage(figures: DataFrame) -> DataFrame:
    """Equity, debt and their ratio; parts before totals, a ratio above 20 is withheld."""
    equity = F.coalesce(F.col("share_capital") + F.col("reserves"), F.col("stated_equity"))
    debt = F.coalesce(F.col("long_borrowings") + F.col("short_borrowings"), F.col("stated_debt"))
    raw = F.when((equity > 0) & debt.isNotNull(), debt / equity)
    known = raw.isNotNull()
    return figures.select(
        "*",
        F.when(known, round_to(equity, 3)).otherwise(F.col("stated_equity")).alias("net_worth"),
        F.when(known, round_to(debt, 3)).otherwise(F.col("stated_debt")).alias("total_debt"),
        F.when(known, F.when(raw <= 20, round_to(raw, 3))).otherwise(F.col("stated_de")).alias("debt_equity_ratio"),
    )


def debt_service(figures: DataFrame) -> DataFrame:
    """Stated cover, else interest cover, else EBITDA over finance cost and current maturities."""
    stated = F.nullif("stated_dscr", F.lit(0.0))
    proxy = F.when(F.col("interest_coverage") > 0, F.col("interest_coverage"))
    service = F.col("finance_cost") + F.greatest(F.coalesce("current_maturities", F.lit(0.0)), F.lit(0.0))
    computed = F.when(F.col("finance_cost") > 0, round_to(F.col("ebitda") / service, 3))
    return figures.select(
        "*",
        F.coalesce(stated, proxy, computed, F.col("stated_dscr")).alias("dscr"),
        F.when(stated.isNotNull(), "stated")
        .when(proxy.isNotNull(), "interest_coverage_proxy")
        .when(computed.isNotNull(), "ebitda_over_finance_costs")
        .alias("dscr_source"),
    )


def statement_facts(cells: DataFrame) -> DataFrame:
    return debt_service(leverage(statement_figures(cells)))


def _first_sheet(cells: DataFrame, words: list[str]) -> DataFrame:
    """First sheet per file, in the workbook's order, whose name holds one of the words."""
    return (
        cells.filter(has_any(F.lower("sheet"), words))
        .groupBy("company_id", "file_name")
        .agg(F.min(F.struct("sheet_no", "sheet")).alias("first"))
        .select("company_id", "file_name", "first.*")
    )


def credit_reconciliation(cells: DataFrame) -> DataFrame:
    """Purchase-register credit against claimed credit per workbook."""
    chosen = _first_sheet(cells, RECON_SHEETS)
    recon = cells.join(chosen, SHEET, "left_semi")
    numeric = (F.col("row_idx") == 2) & F.col("col_idx").between(2, 9) & cell_number(F.col("cell_text"), None).isNotNull()
    columns = recon.groupBy(*SHEET).agg(F.coalesce(F.min(F.when(numeric, F.col("col_idx"))), F.lit(2)).alias("value_col"))
    wide = (
        label_values(sheet_rows(recon), columns, RECON_LABELS)
        .groupBy("company_id", "file_name")
        .pivot("figure", list(RECON_LABELS))
        .agg(F.first("value"))
    )
    year = rlike_first(F.col("cell_text"), r"FY(\d{4}-?\d{2,4})")
    corner = (F.col("row_idx") == 1) & (F.col("col_idx") == 1) & year.isNotNull()
    years = cells.groupBy("company_id", "file_name").agg(
        F.concat(F.lit("FY"), F.min_by(year, F.when(corner, F.col("sheet_no")))).alias("fiscal_year")
    )
    zero = F.lit(0.0)
    available, excess = F.coalesce("itc_available", zero), F.coalesce("itc_excess", zero)
    computed = F.when(available > 0, round_to(excess / available * 100, 2)).otherwise(zero)
    gap = F.coalesce(F.col("stated_mismatch"), computed)
    return years.join(wide, ["company_id", "file_name"], "left").select(
        "company_id",
        "file_name",
        "fiscal_year",
        available.alias("itc_available"),
        F.coalesce("itc_claimed", zero).alias("itc_claimed"),
        excess.alias("itc_excess"),
        gap.alias("itc_mismatch_pct"),
        (gap > 5).alias("has_itc_mismatch"),
        (gap > 20).alias("has_circular_signals"),
    )


def monthly_returns(cells: DataFrame) -> DataFrame:
    """Month rows of the monthly return sheet, below its header cells."""
    sheet = cells.join(_first_sheet(cells, MONTHLY_SHEETS), SHEET, "left_semi")
    text = F.lower(F.trim("cell_text"))
    at = F.struct("row_idx", "col_idx")
    heads = sheet.groupBy(*SHEET).agg(
        F.max(F.when(text.isin(MONTH_HEADERS), at)).alias("month_at"),
        F.max(F.when((F.contains(text, F.lit("outward")) | F.contains(text, F.lit("taxable supply"))), at)).alias("outward_at"),
        F.max(F.when(F.contains(text, F.lit("itc")) & F.contains(text, F.lit("claimed")), at)).alias("itc_at"),
    )
    body = sheet.join(heads.filter(F.col("month_at").isNotNull()), SHEET).filter(F.col("row_idx") > F.col("month_at.row_idx"))
    own = lambda head: F.max(F.when(F.col("col_idx") == F.col(f"{head}.col_idx"), F.col("cell_text")))
    rows = body.groupBy(*SHEET, "row_idx", F.col("outward_at").isNotNull().alias("has_outward"), F.col("itc_at").isNotNull().alias("has_itc")).agg(
        F.trim(own("month_at")).alias("month"), own("outward_at").alias("outward"), own("itc_at").alias("itc")
    )
    return rows.filter(F.col("month") != "").select(
        "company_id",
        "file_name",
        F.col("row_idx").cast("bigint").alias("row_idx"),
        "month",
        F.when(F.col("has_outward"), cell_number(F.col("outward"))).alias("outward_supplies"),
        F.when(F.col("has_itc"), cell_number(F.col("itc"))).alias("itc_claimed"),
    )


def promoter_holding(cells: DataFrame) -> DataFrame:
    """Promoter holding and pledge from rows labelled promoter (not group); the last usable cell wins."""
    rows = sheet_rows(cells).filter(F.contains("label", F.lit("promoter")) & ~F.contains("label", F.lit("group")))
    heads = cells.filter((F.col("row_idx") == 1) & (F.col("col_idx") >= 2)).select(
        *SHEET, "col_idx", F.lower("cell_text").alias("head")
    )
    spread = rows.select(*SHEET, "row_idx", F.inline("values")).join(heads, [*SHEET, "col_idx"])
    at = F.struct("sheet_no", "row_idx", "col_idx")
    is_pledge = F.contains("head", F.lit("pledge")) & (F.col("num") > 0)
    is_holding = (F.contains("head", F.lit("holding")) | F.contains("head", F.lit("%"))) & (F.col("num") > 0) & (F.col("num") <= 100)
    found = spread.groupBy("company_id", "file_name").agg(
        F.max_by("num", F.when(is_holding, at)).alias("holding"),
        F.max_by("num", F.when(is_pledge, at)).alias("pledge"),
        F.max_by("num", F.when(is_pledge & (F.col("num") > 50), at)).alias("high_pledge"),
    )
    high = F.col("high_pledge")
    return cells.select("company_id", "file_name").distinct().join(found, ["company_id", "file_name"], "left").select(
        "company_id",
        "file_name",
        F.coalesce("holding", F.lit(0.0)).alias("promoter_holding_pct"),
        F.coalesce("pledge", F.lit(0.0)).alias("promoter_pledge_pct"),
        F.when(high > 90, "CRITICAL").when(high > 75, "HIGH").when(high > 50, "MEDIUM").alias("pledge_severity"),
    )


def revenue_for_limit(facts: DataFrame) -> DataFrame:
    """First positive revenue of the document fields, else the declared turnover; says which it was.

    Input columns: company_id, revenue_cr, annual_revenue_cr, gross_receipts_cr, revenue_crore,
    revenue_figures (array of double), declared_turnover_cr.
    """
    positive = lambda c: F.when(c > 0, c)
    named = [(n, positive(F.col(n))) for n in ("revenue_cr", "annual_revenue_cr", "gross_receipts_cr", "revenue_crore")]
    named.append(("revenue_figures", positive(F.array_max("revenue_figures"))))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in named], F.lit("declared_turnover"))
    return facts.select(
        "company_id",
        F.coalesce(*[c for _, c in named], F.col("declared_turnover_cr"), F.lit(0.0)).alias("revenue_used_cr"),
        source.alias("revenue_source"),
        F.coalesce(*[c for _, c in named]).isNull().alias("is_fallback"),
    )
