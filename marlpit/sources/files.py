"""Readers of files other than the supplied tables, and their writers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = """dataset_id string, version string, split string, frozen boolean,
 questions array<struct<question_id:string,question:string,answerable:boolean,gold_spans:array<struct<start_seconds:double,end_seconds:double>>>>"""


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; on a local master without one, a temporary folder. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlpit-")
    made = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file or folder; blank lines are skipped, and a missing one is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_dataset(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """The questions of dataset documents, one row each, with their id, version and split. A file is one document, or has one a line."""
    whole = spark.read.schema(DATASET).json(path, multiLine=not one_a_line)
    return whole.select("dataset_id", "version", "split", "frozen", F.explode("questions").alias("q")).select("dataset_id", "version", "split", "frozen", "q.*")


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """path below root, size and time of every file; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return found.select(F.regexp_extract("path", ".*" + re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + "/(.*)", 1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("created_at"))
