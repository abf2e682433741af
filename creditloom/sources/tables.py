"""Access to the given tables and to the domain tables built on them."""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.values import whole_steps
from creditloom.operators.scans import ROWS_TOGETHER, crowded, matching, spread
from creditloom.session import scratch_path
from creditloom.sources.stand_ins import CENTS, RAW, STAND_INS, cell_grid, sheet_numbers, with_clause

#: Share of a line's tax that the vendor has paid.
AVAILABLE = "CASE WHEN l_linenumber = 1 THEN l_tax * 0.8 ELSE l_tax END"

_STAGED: dict[tuple[str, str, str], str] = {}
_LOCKS: dict[tuple[str, str, str], threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def drop_staged(spark: SparkSession) -> None:
    """Removes the steps that this application has written; for the end of a run, when no table built on them is read any more."""
    mine = spark.sparkContext.applicationId
    with _LOCKS_GUARD:
        for key in [k for k in _STAGED if k[0] == mine]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop(key))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Lazy tables of one data folder; `t.ledger` is the domain table `c_ledger`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step written once to the shared folder and read back by all later steps.

        Keeps long chains from being planned and run again per use, and a lost executor
        from reaching back beyond the last written step. Queries of one session over the
        same folder share the written steps, as long as the folder's files stay the same.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, f"{name}-{self.stamp}")
        with _LOCKS_GUARD:
            lock = _LOCKS.setdefault(key, threading.Lock())
        with lock:
            path = _STAGED.get(key)
            if path is None or not self._exists(path):
                path = scratch_path(self.spark, name)
                build().write.parquet(path)
                _STAGED[key] = path
        return self.spark.read.parquet(path)

    @cached_property
    def stamp(self) -> str:
        """Hash of the paths, sizes and times of the input files; a changed file gives another one."""
        paths = [f"{self.folder}/{r}.parquet" for r in RAW]
        files = self.spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").cast("long"))
        return hashlib.sha256(repr(sorted(map(tuple, files.collect()))).encode()).hexdigest()[:16]

    def together(self, *steps: Callable[[], DataFrame]) -> None:
        """Runs independent staged steps side by side."""
        with ThreadPoolExecutor(len(steps)) as pool:
            for done in [pool.submit(s) for s in steps]:
                done.result()

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @property
    def cells(self) -> DataFrame:
        """Stored workbook cells; same rows as the `c_cells` text, written as one explode per company row."""
        return self.staged("cells", self._make_cells)

    def _make_cells(self) -> DataFrame:
        order = sheet_numbers()
        grid = F.array(*[
            F.when(F.expr(keep), F.struct(
                F.lit(order[sheet]).cast("bigint").alias("sheet_no"), F.lit(sheet).alias("sheet"), F.lit(row).alias("row_idx"), F.lit(col).alias("col_idx"), F.expr(text).alias("cell_text")
            ))
            for sheet, row, col, text, keep in cell_grid()
        ])
        file_name = F.concat(F.lit("co"), F.col("company_id").cast("string"), F.lit("_book.xlsx"))
        return self.totals.select("company_id", file_name.alias("file_name"), F.inline(F.array_compact(grid)))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"c_{name}" not in STAND_INS:
            raise AttributeError(name)
        return self._read(name, STAND_INS)

    @property
    def month(self) -> DataFrame:
        """Ledger lines summed per company and month, written once; same rows as the `c_month` text, with the two sums more that `totals` needs."""
        return self.spark.sql(self._month_text)

    @cached_property
    def _month_text(self) -> str:
        """Lines of ordinary size are summed as whole numbers; the rest, if there are any, as decimals in a second pass."""
        sums = self.staged("month_sums", self._month_sums)
        if sums.where("n_rest > 0").isEmpty():
            return self._whole_months()
        self.staged("month", self._mixed_month)
        return f"SELECT * FROM parquet.`{self._path('month')}`"

    def _path(self, name: str) -> str:
        return _STAGED[(self.spark.sparkContext.applicationId, self.folder, f"{name}-{self.stamp}")]

    def _month_lines(self) -> DataFrame:
        """A line's amounts in whole steps of their last decimal place, and whether all of them are known and small: sums of 2^29 such products fit a long."""
        steps = {"cents": ("l_extendedprice", 100), "tax": ("l_tax", 100), "discount": ("l_discount", 100), "available": (AVAILABLE, 1000), "quantity": ("l_quantity", 1)}
        lines = self.raw("lineitem").select(
            "*", F.col("l_suppkey").alias("company_id"), F.expr("cast(date_trunc('month', l_shipdate) as date)").alias("period"), F.col("l_returnflag").alias("flag"),
            *[whole_steps(F.expr(x), n).alias(f"n_{c}") for c, (x, n) in steps.items()])
        small = F.lit(True)
        for c in steps:
            small = small & (F.abs(f"n_{c}") < (1 << 26 if c in ("cents", "quantity") else 1 << 8))
        return lines.withColumn("whole", F.coalesce(small, F.lit(False)))

    def _month_sums(self, limit: int = ROWS_TOGETHER // 2) -> DataFrame:
        """The months' sums. Lines are dealt by month, about `limit` to a task: of few lines a month, summing before that would keep nearly all of them in memory. Crowded months are summed first."""
        keys, whole = ["company_id", "period"], F.col("whole")
        lines = self._month_lines().select(*keys, "flag", "whole", "n_tax", "n_discount", "n_available", F.when(whole, F.col("n_cents")).alias("cents"), F.when(whole, F.col("n_quantity")).alias("quantity"))
        rows = lines.count()
        hot = crowded(lines.select(*keys), keys, limit)
        dealt = lambda some: self._summed(spread(some, keys, rows, limit))
        if hot.isEmpty():
            return dealt(lines)
        return dealt(matching(lines, hot, keys, "left_anti")).unionByName(self._summed(matching(lines, hot, keys, "left_semi")))

    def _summed(self, lines: DataFrame) -> DataFrame:
        flag, whole, cents = F.col("flag"), F.col("whole"), F.col("cents")
        vendor = lambda v: F.sum(F.when(whole, F.when(flag == v, cents * F.col("n_available")).otherwise(0))).alias(f"vendor_{v.lower()}")
        return lines.groupBy("company_id", "period").agg(
            F.sum(cents).alias("outward"), F.sum(cents * F.col("n_tax")).alias("claimed"), F.sum(cents * F.col("n_discount")).alias("paid"),
            F.sum(F.when(whole, F.when(flag == "R", 0).otherwise(cents))).alias("credits"), vendor("A"), vendor("N"), vendor("R"),
            F.count("cents").alias("n_rows"), F.sum("quantity").alias("qty"), F.count_if(~whole).alias("n_rest"))

    def _whole_months(self) -> str:
        """The whole-number sums as the decimals of `c_month`. In whole steps, what a discount leaves is 100 less the discount."""
        big = lambda c: f"cast({c} as decimal(28,0))"
        to = lambda n, step, c, kind: f"cast({n} * {step}BD as {kind}) AS {c}"
        columns = [
            to(big("outward"), "0.01", "outward", "decimal(28,2)"), *[to(big(c), "0.0001", c, "decimal(33,4)") for c in ("claimed", "paid")],
            to(f"cast({big('outward')} * 100BD - {big('paid')} as decimal(28,0))", "0.0001", "sales", "decimal(33,4)"), to(big("credits"), "0.01", "credits", "decimal(28,2)"),
            *[to(big(c), "0.00001", c, "decimal(35,5)") for c in ("vendor_a", "vendor_n", "vendor_r")]]
        return f"SELECT company_id, period, {', '.join(columns)}, n_rows, {big('qty')} AS qty FROM parquet.`{self._path('month_sums')}`"

    def _mixed_month(self) -> DataFrame:
        # What several sums read is worked out once per line.
        lines = self._month_lines().where(~F.col("whole")).selectExpr(
            "company_id", "period", f"{CENTS} AS cents", "cast(l_tax as decimal(4,2)) AS tax", "cast(l_discount as decimal(4,2)) AS discount", "cast(1 - l_discount as decimal(4,2)) AS kept", "flag",
            f"cast({AVAILABLE} as decimal(6,3)) AS available", "cast(l_quantity as decimal(18,0)) AS quantity")
        cents, flag = F.col("cents"), F.col("flag")
        vendor = lambda v: F.sum(F.when(flag == v, cents * F.col("available")).otherwise(0)).alias(f"vendor_{v.lower()}")
        rest = lines.groupBy("company_id", "period").agg(
            F.sum(cents).alias("outward"), F.sum(cents * F.col("tax")).alias("claimed"), F.sum(cents * F.col("discount")).alias("paid"), F.sum(cents * F.col("kept")).alias("sales"),
            F.sum(F.when(flag == "R", F.lit(0).cast("decimal(18,2)")).otherwise(cents)).alias("credits"), vendor("A"), vendor("N"), vendor("R"),
            F.count("*").alias("n_rows"), F.sum("quantity").alias("qty"))
        both = self.spark.sql(self._whole_months()).unionByName(rest).groupBy("company_id", "period")
        return both.agg(*[F.sum(c).cast(kind).alias(c) for c, kind in rest.dtypes[2:]])

    @property
    def monthly(self) -> dict[str, DataFrame]:
        """The four monthly tables off one written aggregate of the ledger lines, so they are not summed four times."""
        texts = {**STAND_INS, "c_month": self._month_text}
        return {name: self._read(name, texts) for name in ("gstr3b", "gstr2a", "gstr1", "credits")}

    @property
    def itr(self) -> DataFrame:
        """Yearly returns; same rows as the `c_itr` text. The months' sums are exact, so the years' are sums of them."""
        total = lambda c, name: F.sum(c).cast("double").alias(name)
        return self.month.groupBy("company_id", F.year("period").alias("assessment_year")).agg(total("sales", "gross_revenue"), total("paid", "taxable_income"), total("claimed", "tax_paid"))

    @property
    def totals(self) -> DataFrame:
        """Company totals; same rows as the `c_totals` text, off the months' sums."""
        return self.month.groupBy("company_id").agg(F.sum("n_rows").alias("n_rows"), F.sum("outward").cast("double").alias("gross"), F.sum("qty").cast("double").alias("qty"))

    def _read(self, name: str, texts: dict[str, str]) -> DataFrame:
        text = with_clause(f"SELECT * FROM c_{name}", texts)
        tables = "|".join(RAW)
        text = re.sub(
            rf"\b(FROM|JOIN)\s+({tables})\b",
            lambda m: f"{m[1]} parquet.`{self.folder}/{m[2]}.parquet` AS {m[2]}"
            if not re.match(r"\s+[dl]\b", text[m.end():m.end() + 3])
            else f"{m[1]} parquet.`{self.folder}/{m[2]}.parquet`",
            text,
        )
        return self.spark.sql(text)
