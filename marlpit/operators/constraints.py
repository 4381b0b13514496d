"""Constraints of the lecture tables as plans: rules of a row, keys that occur once, and rules of evaluation datasets.

A rule is a condition in SQL that a row breaks where it is false; where it is unknown the row passes, as in a table's own
check. All rules of a table are counted in one pass. A key with a NULL in it conflicts with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.schema import JOB_STATUSES, LECTURE_STATUSES, STAGES


def _in(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


#: The rules of each table's rows, and its keys.
ROW_RULES = {
    "lectures": {
        "user_id_present": "user_id is not null",
        "title_present": "title is not null",
        "title_length": "length(trim(title)) between 1 and 300",
        "subject_length": "length(subject) <= 120",
        "topic_length": "length(topic) <= 200",
        "instructor_length": "length(instructor) <= 120",
        "source_type": "source_type in ('video', 'audio', 'url')",
        "source_url_length": "length(source_url) <= 2048",
        "source_url_matches_type": "(source_type = 'url') = (source_url is not null)",
        "status": _in("status", LECTURE_STATUSES),
        "duration": "duration_seconds >= 0",
    },
    "jobs": {
        "status": _in("status", JOB_STATUSES),
        "current_stage": _in("current_stage", STAGES),
        "attempt_count": "attempt_count >= 0",
        "max_attempts": "max_attempts >= 1",
        "error_message_length": "length(error_message) <= 1000",
        "status_detail_length": "length(status_detail) <= 300",
        "running_has_lease": "status <> 'running' or (lease_owner is not null and lease_expires_at is not null)",
    },
    "stage_runs": {
        "status": "status in ('running', 'succeeded', 'failed')",
        "stage": _in("stage", STAGES),
        "attempt": "attempt >= 1",
        "duration": "duration_ms >= 0",
    },
    "chunks": {
        "sequence": "sequence >= 0",
        "text_length": "length(text) > 0",
        "start": "start_seconds >= 0",
        "time_order": "end_seconds >= start_seconds",
        "segment_order": "last_segment >= first_segment",
        "token_estimate": "token_estimate > 0",
        "embedding_has_model": "(embedding is null) = (embedding_model is null)",
    },
    "questions": {
        "question_length": "length(question) between 1 and 1000",
        "outcome": "outcome in ('answered', 'insufficient_evidence')",
        "answer_length": "length(answer) <= 8000",
        "search_ms": "search_ms >= 0",
        "llm_ms": "llm_ms >= 0",
        "latency_present": "latency_ms is not null",
        "latency_ms": "latency_ms >= 0",
    },
}
KEYS = {
    "lectures": [("user_id", "client_request_id"), ("user_id", "source_fingerprint")],
    "jobs": [("lecture_id",)],
    "stage_runs": [("job_id", "stage", "attempt")],
    "chunks": [("lecture_id", "sequence")],
}


def broken_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n): how many rows break each rule; rules that hold have 0. One aggregation over the rows."""
    counts = rows.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    return counts.select(F.inline(pairs))


def repeated_keys(rows: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """(rule, n): rows beyond the first of every key, for each of the keys."""
    out = None
    for key in keys:
        whole = rows.select(*key).dropna("any", subset=list(key))
        n = whole.groupBy(*key).agg((F.count("*") - 1).alias("more")).agg(F.lit("unique " + ", ".join(key)).alias("rule"), F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n) for all tables that have rules; columns that a table lacks leave their rules out."""
    out = None
    for name, rows in tables.items():
        parts = [broken_rules(rows, {k: r for k, r in ROW_RULES.get(name, {}).items()})]
        keys = [k for k in KEYS.get(name, []) if set(k) <= set(rows.columns)]
        if keys:
            parts.append(repeated_keys(rows, keys))
        for p in parts:
            named = p.select(F.lit(name).alias("table_name"), "rule", "n")
            out = named if out is None else out.unionByName(named)
    return out


def dataset_problems(datasets: DataFrame, lectures: DataFrame, questions: DataFrame) -> DataFrame:
    """(dataset_id, subject, problem) of evaluation datasets.

    datasets (dataset_id, split, kind, frozen, frozen_at), lectures (dataset_id, lecture_key), questions (dataset_id, question_id,
    lecture_key, answerable, gold_spans: array of (start_seconds, end_seconds), reference_answer)."""
    spans = F.coalesce(F.size("gold_spans"), F.lit(0)) > 0
    blank = F.trim(F.coalesce("reference_answer", F.lit(""))) == ""
    backwards = F.exists(F.coalesce("gold_spans", F.array().cast("array<struct<start_seconds:double,end_seconds:double>>")), lambda s: (s["end_seconds"] <= s["start_seconds"]) | (s["start_seconds"] < 0))
    known = lectures.select("dataset_id", "lecture_key", F.lit(True).alias("known")).distinct()
    met = questions.join(known, ["dataset_id", "lecture_key"], "left")
    found = {
        "answerable_without_gold": F.col("answerable") & (~spans | blank),
        "unanswerable_with_gold": ~F.col("answerable") & spans,
        "span_order": backwards,
        "unknown_lecture": F.col("known").isNull(),
    }
    each = met.select("dataset_id", F.col("question_id").alias("subject"), F.explode(F.filter(F.array(*[F.when(c, k) for k, c in found.items()]), lambda x: x.isNotNull())).alias("problem"))
    repeated = questions.groupBy("dataset_id", F.col("question_id").alias("subject")).count().where("count > 1").select("dataset_id", "subject", F.lit("repeated_question").alias("problem"))
    keys = lectures.groupBy("dataset_id", F.col("lecture_key").alias("subject")).count().where("count > 1").select("dataset_id", "subject", F.lit("repeated_lecture").alias("problem"))
    filled = datasets.join(lectures.groupBy("dataset_id").agg(F.count("*").alias("l")), "dataset_id", "left").join(questions.groupBy("dataset_id").agg(F.count("*").alias("q")), "dataset_id", "left")
    whole = {"no_lectures": F.col("l").isNull(), "no_questions": F.col("q").isNull(), "split": ~F.col("split").isin("calibration", "dev", "test"), "frozen_without_time": F.col("frozen") & F.col("frozen_at").isNull()}
    of_whole = filled.select("dataset_id", F.lit(None).cast("string").alias("subject"), F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), k) for k, c in whole.items()]), lambda x: x.isNotNull())).alias("problem"))
    return each.unionByName(repeated).unionByName(keys).unionByName(of_whole)
