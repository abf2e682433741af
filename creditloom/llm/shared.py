"""Written steps in the folder that all executors share."""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import creditloom
from creditloom.session import scratch_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so tasks can import it wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(creditloom.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="creditloom-code-"), "creditloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("creditloom", os.path.relpath(path, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


class Steps:
    """Tables written below one fresh folder per run. Each write cuts the lineage, so a lost executor costs one step at most."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.folder = scratch_path(spark, label)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads. What can't be removed stays and is logged."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True):
                logging.getLogger(__name__).warning("left behind: %s/%s", self.folder, name)

    def keyed(self, name: str, df: DataFrame) -> tuple[DataFrame, str]:
        """The table written with a number per row, and the column that holds it, whose name clashes with none."""
        key = "row_key"
        while key.lower() in [c.lower() for c in df.columns]:
            key += "_"
        return self.write(name, df.withColumn(key, F.monotonically_increasing_id())), key
