"""The lecture library: owner-scoped pages, search, counts, history and dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.text import like_pattern
from marlpit.schema import FINAL_STATUSES, READY_SHOWN

#: Orders of the library; ties end on the id.
SORTS = {
    "newest": [F.desc, "created_at", F.desc, "lecture_id"],
    "oldest": [F.asc, "created_at", F.asc, "lecture_id"],
    "title": [F.asc, "title", F.desc, "created_at", F.desc, "lecture_id"],
    "duration": [F.desc_nulls_last, "duration_seconds", F.desc, "created_at", F.desc, "lecture_id"],
}


def sort_columns(name: str) -> list[Column]:
    flat = SORTS[name]
    return [flat[i](flat[i + 1]) for i in range(0, len(flat), 2)]


def owned(df: DataFrame, owner: str) -> DataFrame:
    """Row security: the rows of one owner. Children go through their lecture with a left semi join."""
    return df.where(F.col("user_id") == owner)


def children(child: DataFrame, lectures: DataFrame) -> DataFrame:
    return child.join(lectures.select("lecture_id"), "lecture_id", "left_semi")


def status_group() -> Column:
    return F.when(F.col("status") == "READY", "ready").when(F.col("status") == "FAILED", "failed").otherwise("processing")


def pages(lectures: DataFrame, sort: str, size: int, offset: int = 0) -> DataFrame:
    """Every owner's page: `place` from 1 on, and `total`, the owner's count before paging.

    The count comes from a small aggregate, so that ranking can stop early in each partition."""
    ranked = lectures.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*sort_columns(sort))).cast("long"))
    totals = lectures.groupBy("user_id").agg(F.count("*").alias("total"))
    return ranked.where((F.col("place") > offset) & (F.col("place") <= offset + size)).join(totals, "user_id")


def search(lectures: DataFrame, query: str) -> DataFrame:
    """Metadata search, literal and case-insensitive."""
    text = F.lower(F.concat_ws(" ", "title", "subject", "topic"))
    return lectures.where(text.like(f"%{like_pattern(query)}%"))


def distinct_subjects(lectures: DataFrame) -> DataFrame:
    s = F.trim("subject")
    return lectures.where(s != "").groupBy("subject").agg(F.count("*").alias("n_lectures"))


def with_job(lectures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every lecture with its job nested, NULL where it has none."""
    nested = jobs.select("lecture_id", F.struct("job_id", "status", "attempt_count").alias("job"))
    return lectures.join(nested, "lecture_id", "left")


def history(chat_logs: DataFrame, lectures: DataFrame, query: str, size: int, oldest_first: bool = False) -> DataFrame:
    """Every user's newest (or oldest) questions that match in question or answer; those whose lecture isn't visible go after paging, and total stays."""
    q = query.strip().lower()
    found = chat_logs.where(F.lower("question").contains(q) | F.coalesce(F.lower("answer").contains(q), F.lit(False)))
    totals = found.groupBy("user_id").agg(F.count("*").alias("total"))
    way = F.asc if oldest_first else F.desc
    order = Window.partitionBy("user_id").orderBy(way("created_at"), way("question_id"))
    page = found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= size)
    return page.join(lectures.select("lecture_id", "title"), "lecture_id").join(totals, "user_id")


def dashboard(lectures: DataFrame, questions: DataFrame, shown: int = READY_SHOWN) -> DataFrame:
    """Counts of every owner. ready_seconds is of the `shown` newest READY lectures; ready_is_partial says that there are more."""
    ready = F.col("status") == "READY"
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("lecture_id"))
    seconds = lectures.where(ready).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= shown).groupBy("user_id").agg(F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("ready_seconds"))
    asked = questions.select("lecture_id").join(lectures.select("lecture_id", "user_id"), "lecture_id").groupBy("user_id").agg(F.count("*").alias("n_questions"))
    counts = lectures.groupBy("user_id").agg(
        F.count("*").alias("n_lectures"),
        (F.count_if(ready) > shown).alias("ready_is_partial"),
        F.count_if(~F.col("status").isin(FINAL_STATUSES)).alias("n_processing"),
        F.count_if(F.col("status") == "FAILED").alias("n_failed"),
    )
    return counts.join(seconds, "user_id", "left").join(asked, "user_id", "left").fillna(0, ["ready_seconds", "n_questions"])
