"""Lake tables on Parquet: predicate read, append/overwrite, upsert on merge keys, names in the catalog.

Every write puts its rows into a folder of its own, dealt into buckets by the merge keys. A manifest, one small file
per snapshot that is written last, lists which buckets of which writes make up the table. Readers take the newest manifest, so a
writer that dies half-way leaves the table as it was, and two writers of one snapshot can't both win. An upsert rewrites the
buckets that hold keys of the updates and takes over all others as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

# The lake schemas.
SCHEMAS = {
    "research_findings": (
        "finding_id string, company_id string, finding_type string, severity string, headline string, summary string, "
        "source_url string, source_name string, source_date date, raw_content string, score_impact double, "
        "cam_section string, research_job_id string, ingested_at timestamp"
    ),
    "cross_validation": (
        "company_id string, gst_vs_bank_gap_pct double, gst_vs_itr_gap_pct double, itr_vs_bank_gap_pct double, dscr double, "
        "data_consistency_score double, fraud_indicators array<string>, anomalies_json string, overall_verdict string, "
        "validated_at timestamp"
    ),
    "gst_annual_summary": (
        "company_id string, financial_year string, gst_annual_turnover double, total_itc_claimed double, "
        "total_itc_available_2a double, itc_overclaim_amount double, overall_itc_gap_pct double, filing_compliance_pct double, "
        "critical_flag_months array<string>, has_circular_trading boolean, ingested_at timestamp"
    ),
    "bank_analytics": (
        "company_id string, period_start date, period_end date, banking_turnover_credits double, avg_monthly_balance double, "
        "circular_transaction_count bigint, circular_transaction_value double, window_dressing_detected boolean, "
        "window_dressing_amount double, emi_payments_annual double, banking_to_gst_ratio double, ingested_at timestamp"
    ),
    "cam_research": (
        "company_id string, company_name string, research_job_id string, research_verdict string, total_findings bigint, "
        "total_score_impact double, cam_narrative string, generated_at timestamp"
    ),
}
MERGE_KEYS = {
    "research_findings": ["finding_id"],
    "cross_validation": ["company_id"],
    "gst_annual_summary": ["company_id", "financial_year"],
    "bank_analytics": ["company_id", "period_start"],
    "cam_research": ["company_id"],
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table's schema, in its order and types."""
    fields = StructType.fromDDL(SCHEMAS[table]).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def _same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe: a null key matches a null key."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


WRITE, BUCKET = "lake_write", "lake_bucket"
REPEATED = "repeated merge key in updates"


@dataclass
class Snapshot:
    """What a manifest holds: parts are (write, bucket), one folder each."""

    schema: str
    keys: list[str] = field(default_factory=list)
    buckets: int = 1
    partition_by: list[str] = field(default_factory=list)
    parts: list[list] = field(default_factory=list)
    version: int = 0

    def schema_with_bucket(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema)).add(BUCKET, IntegerType())


class Lake:
    """Tables below one root. With `schema`, each table also has a view of that name in the catalog, always on its newest snapshot."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, schema: str | None = None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.schema = schema
        if schema:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{self.root}'")

    @classmethod
    def named(cls, spark: SparkSession, schema: str, **options) -> Lake:
        """The lake whose root the catalog keeps as the place of `schema`."""
        return cls(spark, spark.catalog.getDatabase(schema).locationUri, schema=schema, **options)

    # Files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._folder(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._folder(path)
        fs.delete(p, True)

    def _versions(self, table: str) -> list[int]:
        return [int(n[1:9]) for n in self._names(f"{self.root}/{table}/manifests") if n.startswith("v") and n.endswith(".json")]

    def snapshot(self, table: str, version: int | None = None) -> Snapshot | None:
        """The newest snapshot, or that of `version`; None where there is none."""
        versions = self._versions(table)
        if not versions or version not in (None, *versions):
            return None
        version = version or versions[-1]
        fs, p = self._folder(f"{self.root}/{table}/manifests/v{version:08d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def _commit(self, table: str, snapshot: Snapshot) -> None:
        """Makes `snapshot` the newest; fails if another writer has taken its number meanwhile."""
        folder = f"{self.root}/{table}/manifests"
        unfinished = f"{folder}/.{uuid.uuid4().hex}"
        fs, p = self._folder(unfinished)
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if "://" in folder else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(p, self._path(f"{folder}/v{snapshot.version:08d}.json"), plain)
        except Py4JJavaError as failed:
            fs.delete(p, False)
            raise RuntimeError(f"{table}: another writer has written version {snapshot.version}") from failed
        if self.schema:
            self._publish(table, snapshot)

    # Rows

    def _parts_of(self, table: str, snapshot: Snapshot, parts: list[list]) -> DataFrame:
        """Rows of some parts, with their bucket."""
        schema, base = StructType.fromJson(json.loads(snapshot.schema)), f"{self.root}/{table}/data"
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
        paths = [f"{base}/{WRITE}={w}/{BUCKET}={b}" for w, b in parts]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*[f"`{f.name}`" for f in schema.fields], BUCKET)

    def _publish(self, table: str, snapshot: Snapshot) -> None:
        names = ", ".join(f"`{f.name}`" for f in StructType.fromJson(json.loads(snapshot.schema)).fields)
        by_write: dict[str, list[str]] = {}
        for w, b in snapshot.parts:
            by_write.setdefault(w, []).append(str(b))
        reads = [f"SELECT {names} FROM parquet.`{self.root}/{table}/data/{WRITE}={w}/{BUCKET}={{{','.join(b)}}}`" for w, b in by_write.items()]
        if reads:
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.schema}.`{table}` AS " + " UNION ALL ".join(reads))

    def _dealt(self, df: DataFrame, snapshot: Snapshot) -> DataFrame:
        if not snapshot.keys:
            return df.withColumn(BUCKET, F.lit(0))
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*snapshot.keys), F.lit(snapshot.buckets)).cast("int"))

    def _add(self, df: DataFrame, table: str, snapshot: Snapshot) -> list[list]:
        """Writes rows that have their bucket; the parts that this gives."""
        write = uuid.uuid4().hex
        path = f"{self.root}/{table}/data/{WRITE}={write}"
        rows = df.repartition(BUCKET) if snapshot.keys else df
        rows.write.partitionBy(BUCKET, *snapshot.partition_by).parquet(path)
        return [[write, int(n.removeprefix(f"{BUCKET}="))] for n in self._names(path) if n.startswith(BUCKET)]

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def read(self, table: str, where: str | None = None, version: int | None = None) -> DataFrame:
        snapshot = self.snapshot(table, version)
        if snapshot is None:
            raise FileNotFoundError(f"{self.root}/{table}")
        df = self._parts_of(table, snapshot, snapshot.parts).drop(BUCKET)
        return df.filter(where) if where else df

    def write(self, df: DataFrame, table: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
        """Appends to the table or replaces it, as one new snapshot. Appended rows must have the table's columns."""
        old = self.snapshot(table)
        fresh = Snapshot(df.schema.json(), partition_by=list(partition_by), version=old.version + 1 if old else 1)
        if old and mode == "append":
            schema = StructType.fromJson(json.loads(old.schema))
            if sorted(df.columns) != sorted(schema.names):
                raise ValueError(f"{table} has the columns {schema.names}, the rows have {df.columns}")
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
            fresh = Snapshot(old.schema, old.keys, old.buckets, old.partition_by, list(old.parts), fresh.version)
        fresh.parts += self._add(self._dealt(df, fresh), table, fresh)
        self._commit(table, fresh)

    def upsert(self, updates: DataFrame, table: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
        """Replace on equal keys, insert otherwise, as one new snapshot. Repeated keys in the updates are an error, as in MERGE.

        The updates run once: they are written, dealt into buckets, and only the buckets that they fall into are read, merged and written anew.
        A table that was dealt by other keys, or by none, is dealt anew as a whole, once.
        """
        if not keys:
            raise ValueError("merge keys must not be empty")
        old = self.snapshot(table)
        fresh = Snapshot(old.schema if old else updates.schema.json(), list(keys), self.buckets, list(partition_by), [], old.version + 1 if old else 1)
        names = StructType.fromJson(json.loads(fresh.schema)).names
        if sorted(updates.columns) != sorted(names):
            raise ValueError(f"{table} has the columns {names}, the updates have {updates.columns}")
        same = old is not None and old.keys == fresh.keys
        if same:
            fresh.buckets, fresh.partition_by = old.buckets, old.partition_by
        types = StructType.fromJson(json.loads(fresh.schema)).fields
        updates = updates.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in types])
        arrived = f"{self.root}/{table}/arrived/{uuid.uuid4().hex}"
        self._dealt(updates, fresh).repartition(BUCKET).write.partitionBy(BUCKET).parquet(arrived)
        hit = {int(n.removeprefix(f"{BUCKET}=")) for n in self._names(arrived) if n.startswith(BUCKET)}
        if hit:
            news = self.spark.read.schema(fresh.schema_with_bucket()).parquet(arrived)
            copies = F.count("*").over(Window.partitionBy(BUCKET, *keys))
            checked = news.withColumn(BUCKET, F.when(copies > 1, F.raise_error(F.lit(REPEATED)).cast("int")).otherwise(F.col(BUCKET)))
            result = checked
            if old:
                touched = [p for p in old.parts if not same or p[1] in hit]
                was = self._parts_of(table, old, touched)
                was = was if same else self._dealt(was.drop(BUCKET), fresh)
                result = was.join(news.select(BUCKET, *keys), _same_keys(was, news, [BUCKET, *keys]), "left_anti").unionByName(checked)
            try:
                fresh.parts = self._add(result, table, fresh)
            except (PySparkException, Py4JJavaError) as failed:
                if REPEATED in str(failed):
                    raise ValueError(f"{table}: {REPEATED}") from failed
                raise
            fresh.parts += [p for p in old.parts if p[1] not in hit] if same else []
        elif old:
            fresh = Snapshot(old.schema, old.keys, old.buckets, old.partition_by, old.parts, fresh.version)
        self._commit(table, fresh)
        self._remove(arrived)

    def remove_unused(self, table: str, keep: int = 1) -> None:
        """Removes all but the newest `keep` manifests and the data that none of those lists. No writer may be at work meanwhile, and older snapshots can't be read any more."""
        versions = self._versions(table)
        kept = [self.snapshot(table, v) for v in versions[-keep:]]
        used = {tuple(p) for s in kept for p in s.parts}
        for v in versions[:-keep]:
            self._remove(f"{self.root}/{table}/manifests/v{v:08d}.json")
        for w in self._names(f"{self.root}/{table}/data"):
            buckets = [n for n in self._names(f"{self.root}/{table}/data/{w}") if n.startswith(BUCKET)]
            mine = {n for n in buckets if (w.removeprefix(f"{WRITE}="), int(n.removeprefix(f"{BUCKET}="))) in used}
            for gone in [f"/{n}" for n in buckets if n not in mine] if mine else [""]:
                self._remove(f"{self.root}/{table}/data/{w}{gone}")
        self._remove(f"{self.root}/{table}/arrived")

    def upsert_row_table(self, rows: DataFrame, table: str) -> None:
        self.upsert(conform(rows, table), table, MERGE_KEYS[table])
