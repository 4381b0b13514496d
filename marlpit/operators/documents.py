"""A lecture's page as one nested row: every child table is gathered by lecture first, in its order, then joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(rows: DataFrame, name: str, order: list[str], fields: list[Column], key: str = "lecture_id") -> DataFrame:
    """(key, name): an array of structs of the fields for each key, in the given order. As long as a key has rows."""
    sorted_rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*fields).alias("__row"))))
    return rows.groupBy(key).agg(F.transform(sorted_rows, lambda r: r["__row"]).alias(name))


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)


def processing_pages(lectures: DataFrame, jobs: DataFrame, runs: DataFrame, media: DataFrame, implemented: list[str]) -> DataFrame:
    """(lecture_id, lecture, job, stage_runs, media, implemented_stages): job is NULL where there is none, and there are no runs then.

    runs (job_id, stage, status, started_at, duration_ms) come by their start, media (lecture_id, kind, mime_type, file_size) by kind."""
    lecture = lectures.select("lecture_id", F.struct(*lectures.columns).alias("lecture"))
    job = jobs.select("lecture_id", "job_id", F.struct(*[c for c in jobs.columns if c != "lecture_id"]).alias("job"))
    run_lists = gathered(runs, "stage_runs", ["started_at", "stage"], [F.col(c) for c in ("stage", "status", "started_at", "duration_ms")], "job_id")
    media_lists = gathered(media, "media", ["kind"], [F.col(c) for c in ("kind", "mime_type", "file_size")])
    out = lecture.join(job, "lecture_id", "left").join(run_lists, "job_id", "left").join(media_lists, "lecture_id", "left")
    stages = F.array(*map(F.lit, implemented)).alias("implemented_stages")
    return out.select("lecture_id", "lecture", "job", _or_empty(run_lists, "stage_runs"), _or_empty(media_lists, "media"), stages)


def workspace_pages(lectures: DataFrame, transcripts: DataFrame, segments: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lecture_id, lecture, transcript, chapters, chunks): transcript is NULL where there is none; segments without text, which cleaning has
    emptied, aren't shown. All lists are in order of sequence."""
    span = [F.col("sequence"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end")]
    shown = segments.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "")
    segment_lists = gathered(shown, "segments", ["sequence"], [*span, F.col("text")])
    said = transcripts.join(segment_lists, "lecture_id", "left").select("lecture_id", F.struct(*[c for c in transcripts.columns if c != "lecture_id"], _or_empty(segment_lists, "segments")).alias("transcript"))
    chapter_lists = gathered(chapters, "chapters", ["sequence"], [*span, F.col("title")])
    chunk_lists = gathered(chunks, "chunks", ["sequence"], span)
    out = lectures.select("lecture_id", F.struct(*lectures.columns).alias("lecture"))
    for df in (said, chapter_lists, chunk_lists):
        out = out.join(df, "lecture_id", "left")
    return out.select("lecture_id", "lecture", "transcript", _or_empty(chapter_lists, "chapters"), _or_empty(chunk_lists, "chunks"))
