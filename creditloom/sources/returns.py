"""Scans of landed files: ledgers (CSV), tax returns (JSON, XML), income-tax returns (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.text import unescape
from creditloom.functions.values import to_number

LEDGER_COLUMNS = ["date", "debit", "credit", "balance", "narration", "party"]
RETURN_FIELDS = [
    "company_id", "return_type", "type", "period", "outward_supplies", "table_3_1a", "itc_claimed", "table_4a",
    "tax_paid", "total_tax_paid", "invoice_sales_total", "sales", "available_itc",
]
RETURN_SCHEMA = ", ".join(f"{f} string" for f in RETURN_FIELDS) + ", hsn_summary map<string,string>, vendor_purchases map<string,string>"
ITR_SCHEMA = (
    "company_id string, assessment_year string, pan string, gross_revenue string, turnover string, "
    "taxable_income string, tax_paid string, depreciation string"
)


def read_ledger_csv(spark: SparkSession, path: str, company_pattern: str = r"company[=_-](\w+)") -> DataFrame:
    """Ledger files with any header case and order. A company_id column wins over the file path."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    names = {c.strip().lower(): c for c in df.columns}
    pick = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    company = pick("company_id") if "company_id" in names else F.regexp_extract("_metadata.file_path", company_pattern, 1)
    return df.select(company.alias("company_id"), *[pick(n).alias(n) for n in LEDGER_COLUMNS])


def read_returns_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or with multi_line one object or array of months per file."""
    return spark.read.json(path, schema=RETURN_SCHEMA, multiLine=multi_line)


# An element without child elements: its name, and its text with CDATA in it; or an empty element.
_NAME = r"[^\s/>!?<]+"
_ATTRIBUTES = r"""(?:\s(?:[^<>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+)?"""
_CDATA = r"<!\[CDATA\[.*?\]\]>"
_LEAF = rf"(?s)<({_NAME}){_ATTRIBUTES}>((?:[^<]++|{_CDATA})*+)</\1\s*>|<({_NAME}){_ATTRIBUTES}/>"
MAP_FIELDS = ["hsn_summary", "vendor_purchases"]


def _without_notes(text: Column) -> Column:
    """Without comments, declarations and processing instructions; CDATA that holds such text is kept."""
    return F.regexp_replace(text, rf"(?s)({_CDATA})|<!--.*?-->|<\?.*?\?>", "$1")


def xml_leaves(text: Column) -> Column:
    """Array of (tag, value, position): the elements of an XML text that hold no elements, in document order. Any tag may come; attributes are not read."""
    found = F.regexp_extract_all(_without_notes(text), F.lit(_LEAF), F.lit(0))
    tag, value = lambda m: F.regexp_extract(m, rf"^<({_NAME})", 1), lambda m: F.regexp_extract(m, _LEAF, 2)
    return F.transform(found, lambda m, i: F.struct(tag(m).alias("tag"), xml_text(value(m)).alias("value"), i.alias("position")))


def xml_text(value: Column) -> Column:
    """Text of an element: character references decoded outside CDATA, CDATA as it stands."""
    pieces = F.regexp_extract_all(value, F.lit(rf"(?s){_CDATA}|[^<]+"), F.lit(0))
    cdata = lambda x: F.startswith(x, F.lit("<![CDATA["))
    return F.array_join(F.transform(pieces, lambda x: F.when(cdata(x), F.substring(x, F.lit(10), F.length(x) - 12)).otherwise(unescape(x))), "")


def field(leaves: Column, tag: str) -> Column:
    """Value of the last element of that name, which is the one that counts; null where there is none."""
    return F.try_element_at(F.filter(leaves, lambda x: x["tag"] == tag), F.lit(-1))["value"]


def xml_map(text: Column, tag: str) -> Column:
    """The leaves of the last element `tag` that holds elements, as a map; the last of equal names counts. Null where there is none."""
    inner = F.try_element_at(F.regexp_extract_all(_without_notes(text), F.lit(rf"(?s)<{tag}{_ATTRIBUTES}>(.*?)</{tag}\s*>"), F.lit(1)), F.lit(-1))
    later = lambda x, leaves: F.exists(leaves, lambda y: (y["tag"] == x["tag"]) & (y["position"] > x["position"]))
    last = lambda leaves: F.transform(F.filter(leaves, lambda x: ~later(x, leaves)), lambda x: F.struct(x["tag"], x["value"]))
    # One-element arrays hold what is used twice, so that it is worked out once.
    entries = F.transform(F.array(xml_leaves(inner)), last)
    filled = F.transform(entries, lambda e: F.when(F.size(e) > 0, F.map_from_entries(e)))[0]
    return F.when(F.contains(text, F.lit(f"<{tag}")), filled)


def read_xml_records(spark: SparkSession, path: str, row_tag: str = "return") -> DataFrame:
    """One row per element `row_tag` of the files: the file and the text inside the element."""
    # Files are cut at the closing tag by the scan itself, so one large file is read by many tasks and no record is held with others.
    cut = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    opens = rf"(?s)^.*?<{row_tag}{_ATTRIBUTES}>"
    before = F.regexp_extract("value", rf"(?s)^(.*?)<{row_tag}(?=[\s>])", 1)
    commented = before.rlike(r"(?s)<!--(?:(?!-->).)*$")
    return cut.where(F.col("value").rlike(opens) & ~commented).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", opens, "").alias("text"))


def read_returns_xml(spark: SparkSession, path: str, row_tag: str = "return") -> DataFrame:
    """XML returns, whatever tags they use: the fields of a return by their names, of equal tags the last in the document, both map fields, and all leaves."""
    fields = lambda x: F.struct(
        *[field(x, f).alias(f) for f in RETURN_FIELDS], *[xml_map(F.col("text"), f).alias(f) for f in MAP_FIELDS], x.alias("leaves"))
    # A row of its own from here on, so that later steps use the leaves and don't work them out per field.
    return read_xml_records(spark, path, row_tag).select(F.inline(F.transform(F.array(xml_leaves(F.col("text"))), fields)))


def return_kind(df: DataFrame) -> DataFrame:
    """Adds `kind`: by declared type, else by which fields are there, else REJECT."""
    declared = F.upper(F.coalesce("return_type", "type", F.lit("")))
    says = lambda *words: F.greatest(*[F.contains(declared, F.lit(w)) for w in words], F.lit(False))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    kind = (
        F.when(says("GSTR3B", "GSTR-3B"), "3B")
        .when(says("GSTR1", "GSTR-1"), "1")
        .when(says("GSTR2A", "GSTR-2A", "GSTR2B"), "2A")
        .when(both("outward_supplies", "itc_claimed"), "3B")
        .when(both("invoice_sales_total", "hsn_summary"), "1")
        .when(both("available_itc", "vendor_purchases"), "2A")
        .otherwise("REJECT")
    )
    return df.withColumn("kind", kind)


def _period() -> Column:
    return F.coalesce(F.col("period"), F.lit("unknown")).alias("period")


def summary_return(df: DataFrame) -> DataFrame:
    """Monthly summary return (3B)."""
    return return_kind(df).filter("kind = '3B'").select(
        "company_id",
        _period(),
        to_number(F.coalesce("outward_supplies", "table_3_1a")).alias("outward_supplies"),
        to_number(F.coalesce("itc_claimed", "table_4a")).alias("itc_claimed"),
        to_number(F.coalesce("tax_paid", "total_tax_paid")).alias("tax_paid"),
    )


def sales_return(df: DataFrame) -> DataFrame:
    """Outward invoice return (1)."""
    return return_kind(df).filter("kind = '1'").select(
        "company_id",
        _period(),
        to_number(F.coalesce("invoice_sales_total", "sales")).alias("invoice_sales_total"),
        F.coalesce("hsn_summary", F.create_map().cast("map<string,string>")).alias("hsn_summary"),
    )


def vendor_total(vendors: Column) -> Column:
    return F.aggregate(F.map_values(vendors), F.lit(0.0), lambda s, v: s + v)


def purchase_register(df: DataFrame) -> DataFrame:
    """Purchase register (2A); credit not stated is the sum over vendors."""
    vendors = F.transform_values(
        F.coalesce("vendor_purchases", F.create_map().cast("map<string,string>")), lambda k, v: to_number(v)
    )
    typed = return_kind(df).filter("kind = '2A'").withColumn("vendors", vendors)
    stated = F.when(F.col("available_itc").isNotNull(), to_number(F.col("available_itc")))
    return typed.select(
        "company_id",
        _period(),
        F.coalesce(stated, vendor_total(F.col("vendors"))).alias("available_itc"),
        F.col("vendors").alias("vendor_purchases"),
    )


def read_itr_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Income-tax returns; revenue may be called turnover, tax numbers are upper-cased and blanks dropped."""
    df = spark.read.json(path, schema=ITR_SCHEMA, multiLine=multi_line)
    return df.select(
        "company_id",
        "assessment_year",
        F.nullif(F.upper(F.trim("pan")), F.lit("")).alias("pan"),
        to_number(F.coalesce("gross_revenue", "turnover")).alias("gross_revenue"),
        to_number(F.col("taxable_income")).alias("taxable_income"),
        to_number(F.col("tax_paid")).alias("tax_paid"),
        to_number(F.col("depreciation")).alias("depreciation"),
    )


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cell_lines(cells: DataFrame, rows_per_part: int = 10_000) -> DataFrame:
    """Text dump of a workbook, one tab-separated line per row.

    A long sheet comes in parts of a fixed number of rows, so no single value grows with the data.
    """
    by_row = cells.groupBy("company_id", "file_name", "sheet", "row_idx").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("cell_text", F.lit("")).alias("v")))), lambda s: s["v"]), "\t"
        ).alias("line")
    )
    return (
        by_row.withColumn("part", F.floor((F.col("row_idx") - 1) / rows_per_part))
        .groupBy("company_id", "file_name", "sheet", "part")
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("lines"))
        .select(
            "company_id",
            "file_name",
            "sheet",
            F.col("part").cast("bigint").alias("part"),
            F.concat(
                F.when(F.col("part") == 0, F.concat(F.lit("["), F.col("sheet"), F.lit("]\n"))).otherwise(F.lit("")),
                F.array_join(F.transform("lines", lambda s: s["line"]), "\n"),
            ).alias("text"),
        )
    )
