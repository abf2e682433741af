"""Registered queries over workbook cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import workbook as W

_FILE = ["company_id", "file_name"]

QUERIES = {
    "wb_1_value_columns": lambda t: W.value_columns(t.cells).withColumn("value_col", F.col("value_col").cast("bigint")),
    "wb_2_label_values": lambda t: W.statement_values(t.cells),
    "wb_3_statement_figures": lambda t: W.statement_figures(t.cells),
    "wb_4_leverage": lambda t: W.leverage(W.statement_figures(t.cells)).select(*_FILE, "net_worth", "total_debt", "debt_equity_ratio"),
    "wb_5_debt_service": lambda t: W.debt_service(W.statement_figures(t.cells)).select(*_FILE, "dscr", "dscr_source"),
    "wb_6_credit_reconciliation": lambda t: W.credit_reconciliation(t.cells),
    "wb_7_monthly_returns": lambda t: W.monthly_returns(t.cells),
    "wb_8_promoter_holding": lambda t: W.promoter_holding(t.cells),
}
