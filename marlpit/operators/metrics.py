"""Evaluation metrics: retrieval, abstention, citations, agreement, latency. Undefined rates are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def latency(value: str) -> list[Column]:
    """n, missing, mean, median (interpolated), p90 and p95 (nearest rank), min, max."""
    v = F.col(value)
    return [
        F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.round(F.avg(v), 6).alias("mean"),
        F.median(v).alias("median"),
        F.expr(f"percentile_disc(0.9) within group (order by {value})").cast("long").alias("p90"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").cast("long").alias("p95"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    ]


def latency_by_metric(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.select(*metrics).unpivot([], metrics, "metric", "value").groupBy("metric").agg(*latency("value"))


def overlaps(start: Column, end: Column, gold_start: Column, gold_end: Column, tolerance: float) -> Column:
    """More than a point in common with the widened span."""
    return F.greatest(start, gold_start - tolerance) < F.least(end, gold_end + tolerance)


def _first_ranks(ranked: DataFrame, spans: DataFrame, tolerance: float) -> DataFrame:
    """For every span the ranks of the first relevant passage and of the first that starts inside; NULL where none does."""
    met = spans.join(ranked, "question_id", "left")
    relevant = overlaps(F.col("start_seconds"), F.col("end_seconds"), F.col("gold_start"), F.col("gold_end"), tolerance)
    inside = F.col("start_seconds").between(F.col("gold_start") - tolerance, F.col("gold_end") + tolerance)
    return met.groupBy("question_id", "span_no").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"), F.min(F.when(inside, F.col("rank"))).alias("first_inside"))


def retrieval_by_cut(ranked: DataFrame, spans: DataFrame, cuts: list[int], tolerance: float) -> DataFrame:
    """ranked (question_id, rank, start_seconds, end_seconds), spans (question_id, span_no, gold_start, gold_end) -> for every
    question with spans and every cut: hit, recall, reciprocal rank (of any rank) and timestamp hit. Questions without spans aren't scored."""
    at = _first_ranks(ranked, spans, tolerance).withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    covered, ts = (F.coalesce(F.col(c) <= F.col("cut"), F.lit(False)).cast("int") for c in ("first_rank", "first_inside"))
    return at.groupBy("question_id", "cut").agg(
        F.max(covered).alias("hit"),
        rate(F.sum(covered), F.count("*")).alias("recall"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.min("first_rank")), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.max(ts).alias("timestamp_hit"),
    )


def retrieval_scores(ranked: DataFrame, spans: DataFrame, cut: int, tolerance: float) -> DataFrame:
    """retrieval_by_cut() of one cut."""
    return retrieval_by_cut(ranked, spans, [cut], tolerance).drop("cut")


def evidence_hits(used: DataFrame, spans: DataFrame, tolerance: float) -> DataFrame:
    """used (question_id, start_seconds, end_seconds): the passages left by threshold and budget -> for every question with
    spans whether one of them is relevant to one of its spans; 0 where no passage is left."""
    met = spans.join(used, "question_id", "left")
    relevant = overlaps(F.col("start_seconds"), F.col("end_seconds"), F.col("gold_start"), F.col("gold_end"), tolerance)
    return met.groupBy("question_id").agg(F.max(F.coalesce(relevant, F.lit(False)).cast("int")).alias("evidence_hit"))


def abstention(rows: DataFrame, *by: str) -> DataFrame:
    """rows with answerable and outcome."""
    refused = F.col("outcome") == "insufficient_evidence"
    can = F.col("answerable")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(can).alias("n_answerable"),
        F.count_if(~can).alias("n_unanswerable"),
        F.count_if(refused).alias("n_refused"),
        rate(F.count_if(refused & ~can), F.count_if(refused)).alias("precision"),
        rate(F.count_if(refused & ~can), F.count_if(~can)).alias("recall"),
        rate(F.count_if(refused & can), F.count_if(can)).alias("false_refusal"),
        rate(F.count_if(~refused & ~can), F.count_if(~can)).alias("answered_unanswerable"),
    )


def citation_support(answered: DataFrame, labels: DataFrame) -> DataFrame:
    """answered (question_id, n_cited), labels (question_id, label: full, partial or none)."""
    both = answered.join(labels, "question_id", "left")
    labelled = F.count("label")
    return both.agg(
        F.count("*").alias("n_answered"),
        rate(F.count_if(F.col("n_cited") > 0), F.count("*")).alias("coverage"),
        labelled.alias("n_labelled"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"),
        *[rate(F.count_if(F.col("label") == k), labelled).alias(f"{k}_rate") for k in ("full", "partial", "none")],
    )


def cohen_kappa(labels: DataFrame) -> DataFrame:
    """labels (item, rater_a, rater_b): n, agreement and kappa over the items that both labelled; kappa NULL if chance explains all."""
    both = labels.where("rater_a is not null and rater_b is not null")
    pairs = both.groupBy("rater_a", "rater_b").agg(F.count("*").alias("c"))
    total = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("rater_a") == F.col("rater_b"), F.col("c")).otherwise(0)).alias("same"))
    a = pairs.groupBy(F.col("rater_a").alias("label")).agg(F.sum("c").alias("na"))
    b = pairs.groupBy(F.col("rater_b").alias("label")).agg(F.sum("c").alias("nb"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    expected = F.try_divide(F.col("both").cast("double"), F.col("n").cast("double") * F.col("n"))
    observed = F.try_divide(F.col("same").cast("double"), F.col("n").cast("double"))
    kappa = F.when(expected < 1, F.try_divide(observed - expected, 1 - expected))
    return total.crossJoin(chance).select(F.coalesce("n", F.lit(0)).alias("n"), F.round(observed, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def last_labels(judgments: DataFrame) -> DataFrame:
    """The last label of every (judge_type, question_id), in order of appending."""
    last = judgments.groupBy("judge_type", "question_id").agg(F.max_by("label", "appended").alias("label"))
    return last.groupBy("judge_type", "label").agg(F.count("*").alias("n"))
