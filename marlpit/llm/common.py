"""What the operators share: scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java and Python patterns.
ASCII_SPACE = r"\x20\x09-\x0D"
#: Spark's own switch for the shuffle files of a finished SQL execution.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one is made for local masters; clusters must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dir()
    return path.rstrip("/")


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marlpit-")


class Scratch:
    """Intermediate tables written to the shared folder: they cut lineage and outlive lost executors.

    A table is deleted by drop(), or when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._path(self.root, delete_on_exit=True)

    def _path(self, path: str, delete_on_exit: bool = False):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if delete_on_exit:
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        return fs, p

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back. Once it is written, the shuffle files of that write go."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        conf = self.spark.conf
        before = conf.get(SHUFFLE_CLEANUP, "false")
        conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that save() returned."""
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, p = self._path(path)
            fs.delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """df.where(condition) that isn't moved below the projection which makes its columns, where they would be made twice."""
    return df.withColumn("__row", F.monotonically_increasing_id()).where(f"__row >= 0 and ({condition})").drop("__row")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
