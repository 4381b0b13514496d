"""Who sees which rows, and what goes with a row that goes: callers' views, cascades, failed lectures, retries by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.schema import FINAL_STATUSES

#: Attempts that a retry by hand adds to those made.
RETRY_ATTEMPTS = 3


@dataclass(frozen=True)
class Child:
    """A table whose rows belong to a parent's: `key` names the parent's row, `own` this table's row for its own children."""

    table: str
    parent: str
    key: str
    own: str


def secure(spark: SparkSession, lectures: DataFrame, children: dict[str, DataFrame], owned: dict[str, DataFrame] | None = None) -> list[str]:
    """Temporary SQL table functions my_NAME(caller), one for every table, which give only the caller's rows.

    lectures, and tables in `owned`, have a user_id; rows of `children` are reached through their lecture. A caller that is
    NULL has no rows. The functions are inlined where they are used, so filters and column choices still reach the scans."""
    made = []
    for name, df in {"lectures": lectures, **(owned or {}), **children}.items():
        view = f"secured_{name}"
        df.createOrReplaceTempView(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        mine = "WHERE t.user_id = caller" if name not in children else "LEFT SEMI JOIN secured_lectures l ON t.lecture_id = l.lecture_id AND l.user_id = caller"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION my_{name}(caller STRING) RETURNS TABLE ({columns}) RETURN SELECT t.* FROM {view} t {mine}")
        made.append(f"my_{name}")
    return made


def cascade(tables: dict[str, DataFrame], root: str, key: str, gone: DataFrame, graph: list[Child]) -> dict[str, DataFrame]:
    """What is left of every table once the rows of `root` whose key is in `gone` go, and with them, level by level, all that
    belongs to them. graph: the tables that have a parent, parents before their children; each level is one anti-join.

    Rows whose parent never existed stay, as no deletion reaches them."""
    keys = {root: gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()}
    left = dict(tables)
    left[root] = tables[root].join(keys[root], F.col(key) == F.col("__gone"), "left_anti")
    for c in graph:
        if c.parent not in keys:
            raise ValueError(f"{c.parent} comes after its child {c.table}")
        reached = tables[c.table].join(keys[c.parent], F.col(c.key) == F.col("__gone"), "left_semi")
        left[c.table] = tables[c.table].join(keys[c.parent], F.col(c.key) == F.col("__gone"), "left_anti")
        keys[c.table] = reached.select(F.col(c.own).alias("__gone")).distinct()
    return left


def fail_lectures(lectures: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """lectures, FAILED where an expired job of theirs has no attempt left; those that are READY or FAILED stay as they are."""
    spent = (F.col("status") == "running") & (F.col("lease_expires_at") < now) & (F.col("attempt_count") >= F.col("max_attempts"))
    hit = jobs.where(spent).select("lecture_id", F.lit(True).alias("__spent")).distinct()
    failed = F.col("__spent") & ~F.col("status").isin(FINAL_STATUSES)
    met = lectures.join(hit, "lecture_id", "left")
    return met.withColumn("status", F.when(failed, "FAILED").otherwise(F.col("status"))).drop("__spent").select(*lectures.columns)


def retry(jobs: DataFrame, lectures: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked (lecture_id, user_id): jobs and lectures after these retries by hand, and asked with `answer`.

    not_found: no such lecture of that user, or no job; not_failed: the job isn't failed; not_retryable: trying again can't
    help; retried: the job is queued and due, with RETRY_ATTEMPTS attempts more, and its FAILED lecture queued again.
    jobs have a column retryable."""
    job = jobs.select("lecture_id", F.col("status").alias("job_status"), "retryable")
    own = lectures.select("lecture_id", "user_id", F.lit(True).alias("own"))
    met = asked.join(own, ["lecture_id", "user_id"], "left").join(job, "lecture_id", "left")
    answer = (
        F.when(F.col("own").isNull() | F.col("job_status").isNull(), "not_found")
        .when(F.col("job_status") != "failed", "not_failed")
        .when(~F.coalesce("retryable", F.lit(False)), "not_retryable")
        .otherwise("retried")
    )
    answers = met.select("lecture_id", "user_id", answer.alias("answer"))
    again = answers.where("answer = 'retried'").select("lecture_id", F.lit(True).alias("__again")).distinct()
    hit = F.coalesce(F.col("__again"), F.lit(False))
    moved = {
        "status": F.when(hit, "queued").otherwise(F.col("status")),
        "next_attempt_at": F.when(hit, now).otherwise(F.col("next_attempt_at")),
        "max_attempts": F.when(hit, F.col("attempt_count") + RETRY_ATTEMPTS).otherwise(F.col("max_attempts")),
        "retryable": F.when(~hit, F.col("retryable")),
    }
    jobs_after = jobs.join(again, "lecture_id", "left").withColumns(moved).select(*jobs.columns)
    status = F.when(hit & (F.col("status") == "FAILED"), "QUEUED").otherwise(F.col("status"))
    return jobs_after, lectures.join(again, "lecture_id", "left").withColumn("status", status).select(*lectures.columns), answers
