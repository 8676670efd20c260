"""Intermediate tables for iterative operators.

Rounds are cut by writing a parquet table below the shared checkpoint folder, so a lost
executor re-reads the table instead of replaying all earlier rounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-tidewire-")  # local runs and tests only
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


class Rounds:
    """Writes the state of each round and drops tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, label: str = "state") -> DataFrame:
        path = f"{self.base}/{label}-{self.count}"
        self.count += 1
        # texts take two thirds of the disk that they take with the default
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._tidewire_path = path
        return saved

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tidewire_path", None)
        if path is None:
            return
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once an application, so that they import it wherever they start."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-tidewire-"), "tidewire.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def save_once(df: DataFrame, name: str) -> DataFrame:
    return Rounds(df.sparkSession, name).save(df)
