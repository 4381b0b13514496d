"""Lecture tables from the supplied Parquet tables. Every adapter is a projection (chunks: one join), so filters and
column choices reach the scans. SQL has the same adapters for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("lecture_id"),
        F.col("source").alias("user_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("lang").alias("subject"),
        F.col("source").alias("topic"),
        F.expr("CASE pmod(doc_id, 10) WHEN 0 THEN 'FAILED' WHEN 1 THEN 'EMBEDDING' ELSE 'READY' END").alias("status"),
        F.expr("CASE pmod(doc_id, 3) WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'url' END").alias("source_type"),
        F.expr("CASE WHEN pmod(doc_id, 7) <> 0 THEN n_chars END").alias("duration_seconds"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(pmod(doc_id, 500) AS int), 0, 0)").alias("created_at"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").cast("long").alias("lecture_id"),
        F.col("vec_id").alias("sequence"),
        (F.col("vec_id") * 60.0).alias("start_seconds"),
        (F.col("vec_id") * 60.0 + 55.0).alias("end_seconds"),
        F.expr("CASE WHEN pmod(vec_id, 7) = 6 THEN 'mini-b' ELSE 'mini-a' END").alias("embedding_model"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return vectors


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("lecture_id"),
        F.col("turn").alias("sequence"),
        (F.col("turn") * 5.0).alias("start_seconds"),
        (F.col("turn") * 5.0 + 4.5).alias("end_seconds"),
        F.col("text").alias("raw_text"),
        F.expr("cast(pmod(conv_id * 31 + turn * 17, 100) AS double) / 100").alias("no_speech_prob"),
        F.expr("-cast(pmod(conv_id * 13 + turn * 7, 20) AS double) / 10").alias("avg_logprob"),
    )


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lecture_id"), F.posexplode(F.split("text", "\n")).alias("sequence", "raw_text"))
    return lines.select(
        "lecture_id",
        F.col("sequence").cast("long").alias("sequence"),
        (F.col("sequence") * 5.0).alias("start_seconds"),
        (F.col("sequence") * 5.0 + 4.5).alias("end_seconds"),
        "raw_text",
        F.expr("cast(pmod(lecture_id * 31 + sequence * 17, 100) AS double) / 100").alias("no_speech_prob"),
        F.expr("-cast(pmod(lecture_id * 13 + sequence * 7, 20) AS double) / 10").alias("avg_logprob"),
    )


def chat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("question_id"),
        F.col("user_id").alias("user_id"),
        F.expr("pmod(event_id, 1200)").alias("lecture_id"),
        F.concat_ws(" ", "event_type", "props").alias("question"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("about "), "event_type")).alias("answer"),
        F.when(F.col("event_type") == "error", "insufficient_evidence").otherwise("answered").alias("outcome"),
        F.expr("CASE WHEN event_type <> 'signup' THEN cast(floor(value * 10) AS long) END").alias("llm_ms"),
        F.expr("cast(floor(value) AS long)").alias("search_ms"),
        F.expr("cast(floor(value * 11) AS long)").alias("latency_ms"),
        F.expr("pmod(user_id, 3) > 0").alias("answerable"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("ts").alias("created_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderkey").alias("lecture_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END").alias("status"),
        F.expr("cast(pmod(o_custkey, 4) AS int)").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").alias("queued_at"),
        F.expr("o_orderdate + make_dt_interval(0, 0, cast(pmod(o_custkey, 90) AS int), 0)").alias("next_attempt_at"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN o_orderdate + make_dt_interval(0, 0, 2, 0) END").alias("lease_expires_at"),
        F.col("o_orderpriority").alias("priority"),
    )


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.expr("element_at(array('EXTRACTING_AUDIO','TRANSCRIBING','CLEANING','CHUNKING','EMBEDDING','INDEXING','GENERATING_INTELLIGENCE'), l_linenumber)").alias("stage"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'running' ELSE 'succeeded' END").alias("status"),
        F.expr("CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity * 100 AS long) END").alias("duration_ms"),
        F.col("l_shipdate").alias("started_at"),
        F.col("l_partkey").alias("tie"),
        F.col("l_suppkey").alias("tie2"),
    )


#: The same adapters in SQL, as common table expressions.
SQL = {
    "lectures": """lectures as (select doc_id as lecture_id, source as user_id, split_part(text, chr(10), 1) as title, lang as subject, source as topic,
      case doc_id % 10 when 0 then 'FAILED' when 1 then 'EMBEDDING' else 'READY' end as status,
      case doc_id % 3 when 0 then 'video' when 1 then 'audio' else 'url' end as source_type,
      case when doc_id % 7 <> 0 then n_chars end as duration_seconds, timestamp '2024-01-01' + to_hours(cast(doc_id % 500 as integer)) as created_at from documents)""",
    "chunks": """chunks as (select vec_id as chunk_id, cast(label as bigint) as lecture_id, vec_id as sequence, vec_id * 60.0::double as start_seconds, vec_id * 60.0::double + 55 as end_seconds,
      case when vec_id % 7 = 6 then 'mini-b' else 'mini-a' end as embedding_model, embedding::double[] as embedding from embeddings)""",
    "segments": """segments as (select conv_id as lecture_id, turn as sequence, turn * 5.0::double as start_seconds, turn * 5.0::double + 4.5 as end_seconds, text as raw_text,
      ((conv_id * 31 + turn * 17) % 100)::double / 100 as no_speech_prob, -((conv_id * 13 + turn * 7) % 20)::double / 10 as avg_logprob from conversations)""",
    "line_segments": """line_segments as (select doc_id as lecture_id, unnest(range(len(string_split(text, chr(10))))) as sequence, unnest(string_split(text, chr(10))) as raw_text from documents)""",
    "chat_logs": """chat_logs as (select event_id as question_id, user_id, event_id % 1200 as lecture_id, event_type || ' ' || props as question,
      case when event_type <> 'error' then 'about ' || event_type end as answer, case when event_type = 'error' then 'insufficient_evidence' else 'answered' end as outcome,
      case when event_type <> 'signup' then cast(floor(value * 10) as bigint) end as llm_ms, cast(floor(value) as bigint) as search_ms, cast(floor(value * 11) as bigint) as latency_ms,
      user_id % 3 > 0 as answerable, cast(props->>'$.k' as integer) as k, ts as created_at from events)""",
    "jobs": """jobs as (select o_orderkey as job_id, o_orderkey as lecture_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else 'running' end as status,
      cast(o_custkey % 4 as integer) as attempt_count, 3 as max_attempts, o_orderdate as queued_at, o_orderdate + to_minutes(cast(o_custkey % 90 as integer)) as next_attempt_at,
      case when o_orderstatus = 'P' then o_orderdate + to_minutes(2) end as lease_expires_at, o_orderpriority as priority from orders)""",
    "stage_runs": """stage_runs as (select l_orderkey as job_id, (['EXTRACTING_AUDIO','TRANSCRIBING','CLEANING','CHUNKING','EMBEDDING','INDEXING','GENERATING_INTELLIGENCE'])[l_linenumber] as stage,
      case l_returnflag when 'R' then 'failed' when 'N' then 'running' else 'succeeded' end as status, case when l_returnflag <> 'N' then cast(l_quantity * 100 as bigint) end as duration_ms,
      l_shipdate as started_at, l_partkey as tie, l_suppkey as tie2 from lineitem)""",
}


def with_sql(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
