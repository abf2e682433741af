"""Registered queries: landed files, tax mismatch, reconciliation, lake tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import reconcile as R
from creditloom.plans import chain
from creditloom.plans.ledger_queries import bank_profile_of
from creditloom.session import scratch_path
from creditloom.sources import returns as S
from creditloom.sources.lake import Lake
from creditloom.sources.tables import Tables


def stamp():
    """Load time of the written rows; fixed, so results repeat."""
    return F.to_timestamp(F.lit("2025-01-01 00:00:00"))



def _landed_returns(t: Tables) -> DataFrame:
    """Return payloads with the spellings landed files use, one JSON object per return."""
    month = F.month("period")
    text = lambda c: F.format_number(F.col(c).cast("decimal(24,4)"), 4)
    period = F.when(month < 12, F.col("period").cast("string")).alias("period")
    named = lambda late, early: F.when(month > 6, F.lit(late)).otherwise(F.lit(early))
    company = F.col("company_id").cast("string").alias("company_id")
    b3 = t.gstr3b.select(F.to_json(F.struct(
        company, period,
        F.when(month <= 4, "GSTR-3B").alias("return_type"), F.when(month.between(5, 8), "gstr3b monthly").alias("type"),
        F.when(month > 2, text("outward_supplies")).alias("outward_supplies"), F.when(month <= 2, text("outward_supplies")).alias("table_3_1a"),
        F.when(month > 2, text("itc_claimed")).alias("itc_claimed"), F.when(month <= 2, text("itc_claimed")).alias("table_4a"),
        F.when(month > 6, text("tax_paid")).alias("tax_paid"), F.when(month <= 6, text("tax_paid")).alias("total_tax_paid"),
    )).alias("value"))
    a2 = t.gstr2a.select(F.to_json(F.struct(
        company, period,
        F.when(month <= 6, named("GSTR2B", "GSTR-2A")).alias("return_type"),
        F.when((month > 6) | (month == 1), F.col("available_itc").cast("string")).alias("available_itc"),
        F.create_map(F.lit("A"), F.col("vendor_a").cast("string"), F.lit("N"), F.col("vendor_n").cast("string"),
                     F.lit("R"), F.col("vendor_r").cast("string")).alias("vendor_purchases"),
    )).alias("value"))
    g1 = t.gstr1.select(F.to_json(F.struct(
        company, period, F.when(month <= 9, "GSTR1").alias("type"),
        F.when(month > 3, text("invoice_sales_total")).alias("invoice_sales_total"), F.when(month <= 3, text("invoice_sales_total")).alias("sales"),
        F.create_map(F.lit("7208"), F.lit("1")).alias("hsn_summary"),
    )).alias("value"))
    other = t.itr.select(F.to_json(F.struct(company, F.lit("FORM16").alias("type"), F.col("assessment_year").cast("string").alias("period"))).alias("value"))
    return b3.unionByName(a2).unionByName(g1).unionByName(other)


def _returns(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "returns-json")
    _landed_returns(t).write.text(path)
    return S.read_returns_json(t.spark, path)


def _ledger_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ledger-csv")
    t.ledger.select(
        "company_id", F.col("txn_date").cast("string").alias(" Date "), F.col("party").alias("PARTY"), F.col("debit").alias("Debit"),
        F.col("credit").alias("CREDIT"), F.col("narration").alias("Narration"),
    ).write.csv(path, header=True)
    return S.read_ledger_csv(t.spark, path).select(
        F.col("company_id").cast("bigint").alias("company_id"), "date", "debit", "credit", "balance", "narration", "party"
    )


def _xml_landed(t: Tables, rows: DataFrame) -> DataFrame:
    path = scratch_path(t.spark, "returns-xml")
    rows.write.format("xml").option("rowTag", "return").save(path)
    return S.read_returns_xml(t.spark, path)


def _xml_summaries(t: Tables) -> DataFrame:
    text = lambda c: F.format_number(F.col(c).cast("decimal(24,4)"), 4)
    late = F.month("period") > 6
    return _xml_landed(t, t.gstr3b.select(
        F.struct(F.col("company_id").cast("string").alias("company_id"), F.lit("GSTR3B").alias("return_type"), F.lit("draft").alias("period")).alias("head"),
        F.struct(text("outward_supplies").alias("outward_supplies"), F.when(~late, text("itc_claimed")).alias("table_4a"),
                 F.when(late, text("itc_claimed")).alias("itc_claimed")).alias("body"),
        F.struct(F.col("period").cast("string").alias("period"), F.when(late, F.concat(F.lit("late & <unsigned> "), F.col("company_id"))).alias("filing_note")).alias("tail"),
    ))


def _returns_xml(t: Tables) -> DataFrame:
    return S.summary_return(_xml_summaries(t)).select(F.col("company_id").cast("bigint").alias("company_id"), "period", "outward_supplies", "itc_claimed")


def _xml_leaves(t: Tables) -> DataFrame:
    """All that the returns say, tags that no schema names included; amounts apart, whose spelling is the writer's."""
    leaves = _xml_summaries(t).select(F.col("company_id").cast("bigint").alias("company_id"), F.col("period").alias("filed"), F.inline("leaves"))
    return leaves.where(~F.col("value").rlike(r"\.\d{4}$")).withColumn("position", F.col("position").cast("bigint"))


def _xml_vendors(t: Tables) -> DataFrame:
    """Purchase returns as XML: vendors under their container, no type declared."""
    amount = lambda c: F.col(c).cast("string").alias(c[-1].upper())
    landed = _xml_landed(t, t.gstr2a.select(
        F.struct(F.col("company_id").cast("string").alias("company_id"), F.col("period").cast("string").alias("period"), F.lit("0").alias("N")).alias("head"),
        F.when(F.month("period") <= 6, "GSTR-2A").alias("type"), F.when(F.month("period") > 6, F.col("available_itc").cast("string")).alias("available_itc"),
        F.struct(amount("vendor_a"), amount("vendor_n"), amount("vendor_r")).alias("vendor_purchases"),
    ))
    return _by_company(S.purchase_register(landed)).select("company_id", "period", "available_itc", *[F.element_at("vendor_purchases", v).alias(f"vendor_{v.lower()}") for v in "ANR"])


def _itr_json(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "itr-json")
    even = F.col("assessment_year") % 2 == 0
    t.itr.select(
        F.col("company_id").cast("string").alias("company_id"), F.col("assessment_year").cast("string").alias("assessment_year"),
        F.when(even, " abcde1234f ").otherwise("  ").alias("pan"),
        F.when(even, F.col("gross_revenue").cast("string")).alias("gross_revenue"), F.when(~even, F.col("gross_revenue").cast("string")).alias("turnover"),
        F.col("tax_paid").cast("string").alias("tax_paid"), F.lit("n/a").alias("depreciation"),
    ).write.json(path)
    return S.read_itr_json(t.spark, path).withColumn("company_id", F.col("company_id").cast("bigint"))


def _by_company(df: DataFrame) -> DataFrame:
    return df.withColumn("company_id", F.col("company_id").cast("bigint"))


def _kinds(t: Tables) -> DataFrame:
    kinds = S.return_kind(_returns(t)).groupBy("company_id", "kind").agg(F.count("*").alias("n_returns"))
    return _by_company(kinds)


def _lake(t: Tables) -> Lake:
    return Lake(t.spark, scratch_path(t.spark, "lake"))


def _predicate_read(t: Tables) -> DataFrame:
    lake = _lake(t)
    lake.write(t.itr, "itr", partition_by=["assessment_year"])
    df = lake.read("itr", "assessment_year >= 1998 AND gross_revenue > 1000000")
    return df.select("company_id", F.col("assessment_year").cast("bigint").alias("assessment_year"), "gross_revenue")


def _append_overwrite(t: Tables) -> DataFrame:
    lake = _lake(t)
    lake.write(t.gstr1, "sales", mode="overwrite")
    lake.write(t.gstr3b.select("company_id", "period", F.col("outward_supplies").alias("invoice_sales_total")), "sales", mode="append")
    return lake.read("sales").groupBy("company_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("invoice_sales_total").cast("decimal(24,4)")).cast("double").alias("total")
    )


def _upsert(t: Tables) -> DataFrame:
    """Closed and open orders are in the table; open and pending ones arrive with new amounts."""
    lake, v = _lake(t), t.versions.select("version_id", "company_id", "status", "amount")
    lake.upsert(v.filter("status IN ('F', 'O')"), "orders", ["version_id"])
    lake.upsert(v.filter("status IN ('O', 'P')").withColumn("amount", F.col("amount") * 2), "orders", ["version_id"])
    return lake.read("orders")


def _named_table(t: Tables) -> DataFrame:
    """Written and appended to under a name of the catalog, read by that name alone."""
    root = scratch_path(t.spark, "lake")
    schema = f"lake_{root[-32:]}"
    Lake(t.spark, root, schema=schema).write(t.gstr1, "sales", mode="overwrite")
    Lake.named(t.spark, schema).write(t.gstr3b.select("company_id", "period", F.col("outward_supplies").alias("invoice_sales_total")), "sales")
    return t.spark.table(f"{schema}.sales").groupBy("company_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("invoice_sales_total").cast("decimal(24,4)")).cast("double").alias("total"))


def _one_key(t: Tables) -> DataFrame:
    """All orders, then one of them anew: what the table holds, and how many of its buckets were written for it."""
    lake, v = _lake(t), t.versions.select("version_id", "company_id", "status", "amount")
    lake.upsert(v, "orders", ["version_id"])
    before = lake.snapshot("orders").parts
    last = v.agg(F.max_by(F.struct(*v.columns), "version_id").alias("v")).select("v.*")
    lake.upsert(last.withColumn("amount", F.lit(0.0)), "orders", ["version_id"])
    written = sum(p not in before for p in lake.snapshot("orders").parts)
    return lake.read("orders").groupBy("status").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("amount").cast("decimal(24,4)")).cast("double").alias("total"), F.lit(written).cast("bigint").alias("buckets_written"))


def _stored(t: Tables, rows: DataFrame, table: str) -> DataFrame:
    lake = _lake(t)
    lake.upsert_row_table(rows, table)
    return lake.read(table).drop("ingested_at", "validated_at", "generated_at")


def _annual_tax(t: Tables) -> DataFrame:
    monthly = t.gstr3b.join(t.gstr2a.select("company_id", "period", "available_itc"), ["company_id", "period"])
    stored = _stored(t, R.annual_tax_rows(monthly, chain.monthly_mismatch(t), stamp()), "gst_annual_summary")
    return stored.withColumn("critical_flag_months", F.array_join("critical_flag_months", ","))


def _report_table(t: Tables) -> DataFrame:
    stored = _stored(t, R.report_rows(chain.report(t), stamp()), "cross_validation")
    return stored.withColumn("fraud_indicators", F.array_join("fraud_indicators", "; "))


def _vendor_totals(t: Tables) -> DataFrame:
    vendors = F.create_map(F.lit("A"), F.col("vendor_a"), F.lit("N"), F.col("vendor_n"), F.lit("R"), F.col("vendor_r"))
    return t.gstr2a.select("company_id", "period", S.vendor_total(vendors).alias("vendor_total"))


def _text_rows(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("source_id"), "text")
    pages = t.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("source_id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("kind", "source_id", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES = {
    "src_1_ledger_csv": _ledger_csv,
    "src_2_return_kinds": _kinds,
    "src_3_returns_xml": _returns_xml,
    "src_3_xml_leaves": _xml_leaves,
    "src_3_xml_vendors": _xml_vendors,
    "src_4_summary_return": lambda t: _by_company(S.summary_return(_returns(t))),
    "src_5_sales_return": lambda t: _by_company(S.sales_return(_returns(t))).withColumn("hsn_summary", F.array_join(F.map_keys("hsn_summary"), ",")),
    "src_6_purchase_register": lambda t: _by_company(S.purchase_register(_returns(t))).select(
        "company_id", "period", "available_itc", *[F.element_at("vendor_purchases", v).alias(f"vendor_{v.lower()}") for v in "ANR"]),
    "src_7_itr_json": _itr_json,
    "src_8_cells": lambda t: t.cells.select(
        "company_id", "file_name", "sheet", F.col("row_idx").cast("bigint").alias("row_idx"), F.col("col_idx").cast("bigint").alias("col_idx"), "cell_text"),
    "src_9_text_rows": _text_rows,
    "src_10_predicate_read": _predicate_read,
    "src_11_append_overwrite": _append_overwrite,
    "src_11_named_table": _named_table,
    "src_12_upsert": _upsert,
    "src_12_one_key": _one_key,
    "src_13_annual_tax_table": _annual_tax,
    "src_14_bank_table": lambda t: _stored(t, R.bank_rows(bank_profile_of(t), stamp()), "bank_analytics"),
    "src_15_report_table": _report_table,
    "src_18_cell_lines": lambda t: S.cell_lines(t.cells),
    "agg_10_vendor_total": _vendor_totals,
    "join_2_tax_sides": lambda t: R.tax_sides(t.gstr3b, t.gstr2a, t.gstr1, t.credits, ["company_id", "period"]),
    "join_3_assembled": lambda t: chain.assembled(t).drop("net_cash_flow"),
    "join_10_turnover_by_month": lambda t: R.turnover_by_month(t.gstr3b, t.credits),
    "rec_1_gaps": lambda t: R.gaps(chain.assembled(t)),
    "rec_2_tax_mismatch": chain.monthly_mismatch,
    "rec_3_anomalies": lambda t: R.long_list(chain.report(t), "anomalies"),
    "rec_4_indicators": lambda t: R.long_list(chain.report(t), "indicators"),
    "rec_5_advice": lambda t: R.long_list(chain.report(t), "advice"),
    "rec_6_service_cover": lambda t: chain.report(t).select("company_id", "dscr", "cycle_days"),
    "rec_7_consistency": lambda t: chain.report(t).select("company_id", "consistency_score"),
}
