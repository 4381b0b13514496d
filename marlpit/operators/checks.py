"""Validators: rules that rows must meet, and preconditions of a run. Each returns the rows that break it, or raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.display import MAX_AUDIO_BYTES, MAX_SECONDS, MAX_VIDEO_BYTES

#: Labels of a judgment, by kind.
LABELS = {"correctness": ["correct", "partially_correct", "incorrect"], "citation_support": ["full", "partial", "none"]}
PURPOSES = ["smoke", "benchmark"]


def check_run_policy(split: str, frozen: bool, sweep: bool) -> None:
    """Test data is evaluated once it is frozen, and never swept."""
    if split == "test" and not frozen:
        raise ValueError("test data can only be evaluated once the dataset is frozen")
    if split == "test" and sweep:
        raise ValueError("no parameter sweeps on test data")


def check_purpose(purpose: str, limit: int | None, probes: bool = False) -> None:
    if purpose not in PURPOSES:
        raise ValueError(f"purpose must be one of {PURPOSES}")
    if purpose == "benchmark" and (limit is not None or probes):
        raise ValueError("a benchmark run scores the whole split")
    if purpose == "smoke" and limit is None:
        raise ValueError("a smoke run needs a limit")


def check_judge(judge: tuple[str, str], generator: tuple[str, str], allow_same: bool = False) -> None:
    """(address, model) of both: one of the two must differ."""
    same = judge[1] == generator[1] and judge[0].rstrip("/") == generator[0].rstrip("/")
    if same and not allow_same:
        raise ValueError("an answer can't be judged by the model that wrote it")


def media_problems(media: DataFrame) -> DataFrame:
    """media (id, kind: video or audio, has_audio, seconds, bytes): the first rule that each file breaks, if any."""
    most = F.when(F.col("kind") == "video", MAX_VIDEO_BYTES).otherwise(MAX_AUDIO_BYTES)
    problem = (
        F.when(F.col("bytes") > most, "file_too_large")
        .when(~F.coalesce("has_audio", F.lit(False)), "no_audio_stream")
        .when(F.coalesce("seconds", F.lit(0)) <= 0, "media_unreadable")
        .when(F.col("seconds") > MAX_SECONDS, "media_too_long")
    )
    return media.select("id", problem.alias("problem")).where("problem is not null")


def judgment_problems(judgments: DataFrame, questions: DataFrame, run_id: str) -> DataFrame:
    """judgments (run_id, question_id, kind, label, annotator): those of another run, an unknown question or label, or by nobody."""
    known = questions.select("question_id", F.lit(True).alias("known")).distinct()
    allowed = F.array(*[F.concat_ws(":", F.lit(k), F.lit(v)) for k, vs in LABELS.items() for v in vs])
    problem = (
        F.when(F.col("run_id") != run_id, "other_run")
        .when(F.col("known").isNull(), "unknown_question")
        .when(~F.array_contains(allowed, F.concat_ws(":", "kind", "label")), "unknown_label")
        .when(F.trim(F.coalesce("annotator", F.lit(""))) == "", "no_annotator")
    )
    return judgments.join(known, "question_id", "left").withColumn("problem", problem).drop("known")


def evaluation_lectures(wanted: DataFrame, lectures: DataFrame, chunks: DataFrame, owner: Column, model: str) -> DataFrame:
    """wanted (lecture_id): what keeps a lecture from being evaluated: missing, another owner's, not READY, not embedded by the model."""
    ok = chunks.groupBy("lecture_id").agg(F.count_if(F.col("embedding").isNull() | (F.col("embedding_model") != model)).alias("n_other"))
    met = wanted.join(lectures.select("lecture_id", "user_id", "status"), "lecture_id", "left").join(ok, "lecture_id", "left")
    problem = F.when(F.col("status").isNull(), "missing").when(F.col("user_id") != owner, "other_owner").when(F.col("status") != "READY", "not_ready").when(F.col("n_other").isNull() | (F.col("n_other") > 0), "other_model")
    return met.select("lecture_id", problem.alias("problem"))


def rerun_mismatches(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Two runs (question_id, rank, chunk_id, similarity): questions whose chunks, order or similarities differ."""
    a = before.select("question_id", "rank", F.col("chunk_id").alias("c"), F.col("similarity").alias("s"))
    b = after.select("question_id", "rank", F.col("chunk_id").alias("d"), F.col("similarity").alias("t"))
    same = F.col("c").eqNullSafe(F.col("d")) & (F.abs(F.col("s") - F.col("t")) <= tolerance)
    return a.join(b, ["question_id", "rank"], "full").groupBy("question_id").agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("n_differ")).where("n_differ > 0")


def latest_details(runs: DataFrame, stage: str) -> DataFrame:
    """The details of each job's succeeded run of a stage that finished last: a run's time after its start."""
    finished = F.col("started_at") + F.make_dt_interval(secs=F.col("duration_ms") / F.lit(1000).cast("decimal(10,3)"))
    order = Window.partitionBy("job_id").orderBy(finished.desc_nulls_last(), F.desc("started_at"), F.desc("tie"), F.desc("tie2"))
    return runs.where((F.col("stage") == stage) & (F.col("status") == "succeeded")).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def readiness(workers: DataFrame, database: Column, queue: Column) -> DataFrame:
    """workers (busy): how many, how many busy, and the state of the whole."""
    counts = workers.agg(F.count("*").alias("n_workers"), F.count_if("busy").alias("n_busy"))
    return counts.withColumn("status", F.when(database & queue & (F.col("n_workers") > 0), "ok").when(database, "degraded").otherwise("unavailable"))
