"""Callers' views, cascades, retries by hand, and experiments in a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.operators import ablation, access, constraints
from marlpit.plans import search
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql

NOW, CALLERS, MOST = "1998-06-01 00:00:00", ("src1", "src2"), 10
GRAPH = [access.Child("chunks", "lectures", "lecture_id", "chunk_id"), access.Child("segments", "lectures", "lecture_id", "sequence"), access.Child("jobs", "lectures", "lecture_id", "job_id"), access.Child("stage_runs", "jobs", "job_id", "stage")]
#: (config, rag_top_k, rag_min_similarity, rag_context_tokens); NULL: the default.
SWEEPS = [("base", None, 0.2, None), ("few", 3, 0.2, None), ("strict", None, 0.3, 400), ("wide", 10, 0.1, 5000)]
SWEEP_COLUMNS = "config string, rag_top_k int, rag_min_similarity double, rag_context_tokens int"


def secured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two callers see of each table: rows, and the least and largest lecture."""
    names = access.secure(spark, t.lectures(spark, sf_dir), {"chunks": t.chunks(spark, sf_dir), "segments": t.segments(spark, sf_dir), "jobs": t.jobs(spark, sf_dir)}, {"questions": t.chat_logs(spark, sf_dir).drop("user_id").withColumn("user_id", F.concat(F.lit("src"), F.pmod("lecture_id", F.lit(20))))})
    asked = [f"SELECT '{c}' AS caller, '{n}' AS source, count(*) AS n, min(lecture_id) AS first, max(lecture_id) AS last FROM {n}('{c}')" for c in CALLERS for n in names]
    return spark.sql(" UNION ALL ".join(asked))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: getattr(t, n)(spark, sf_dir) for n in ("lectures", "chunks", "segments", "jobs", "stage_runs")}


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the lectures goes: how many rows of each table are left."""
    tables = _tables(spark, sf_dir)
    left = access.cascade(tables, "lectures", "lecture_id", tables["lectures"].where("pmod(lecture_id, 7) = 3").select("lecture_id"), GRAPH)
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_left"))
        out = n if out is None else out.unionByName(n)
    return out


def failed_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lectures after jobs whose lease ran out on their last attempt have failed them."""
    jobs = t.jobs(spark, sf_dir).withColumn("max_attempts", F.lit(2))
    return access.fail_lectures(t.lectures(spark, sf_dir), jobs, F.expr(f"timestamp_ntz'{NOW}'")).select("lecture_id", "status")


def _failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("status").isin("running", "succeeded") & (F.col("job_id") % 3 > 0)
    jobs = t.jobs(spark, sf_dir)
    return jobs.withColumns({"retryable": F.when(failed, F.col("job_id") % 4 > 0), "status": F.when(failed, "failed").otherwise(F.col("status"))})


def manual_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lecture's retry, asked for by its owner or (each fifth) by another: the answer, and job and lecture afterwards."""
    lectures = t.lectures(spark, sf_dir)
    asked = lectures.select("lecture_id", F.when(F.col("lecture_id") % 5 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"))
    jobs, after, answers = access.retry(_failed_jobs(spark, sf_dir), lectures, asked, F.expr(f"timestamp_ntz'{NOW}'"))
    job = jobs.select("lecture_id", F.col("status").alias("job_status"), "max_attempts", "next_attempt_at", "retryable")
    return answers.select("lecture_id", "answer").join(after.select("lecture_id", "status"), "lecture_id").join(job, "lecture_id", "left")


def override_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides rebuilt from documents: eight for each configuration, of allowed keys and others, with texts of any kind."""
    keys = [*ablation.OVERRIDABLE, "database_url"]
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), (F.col("n_chars") / 16).cast("string"))).otherwise(F.col("source"))
    rows = t.table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("config"), F.get(F.array(*map(F.lit, keys)), F.pmod("doc_id", F.lit(len(keys))).cast("int")).alias("key"), raw.alias("raw"))
    return ablation.typed_overrides(rows).withColumn("refused", F.array_join("refused", ","))


def ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four configurations times the eight settings of the abstention switches, over every query."""
    chunks = t.chunks(spark, sf_dir)
    q = search._queries(chunks)
    tokens = t.chunk_texts(spark, sf_dir).select("chunk_id", tx.estimate_tokens(F.col("text")).alias("token_estimate"))
    answers = q.select("query_id", (F.col("query_id") % 3 > 0).alias("answerable"), F.array((F.col("query_id") / 50 % 5).cast("int")).alias("cited"), F.when(F.col("query_id") % 7 == 0, " ").otherwise("said").alias("answer"))
    return ablation.run_grid(q, chunks, tokens, answers, ablation.grid(spark.createDataFrame(SWEEPS, SWEEP_COLUMNS)), MOST)


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules and repeated keys of five tables. The supplied columns break some of them; others are made to."""
    lec = t.lectures(spark, sf_dir).withColumns({
        "instructor": F.repeat("subject", F.when(F.col("lecture_id") % 50 == 1, 61).otherwise(1)), "source_url": F.when((F.col("source_type") == "url") != (F.col("lecture_id") % 9 == 0), F.concat(F.lit("https://x/"), "lecture_id")),
        "client_request_id": F.when(F.col("lecture_id") % 4 > 0, F.pmod("lecture_id", F.lit(97))), "source_fingerprint": F.sha2("title", 256), "status": F.when(F.col("lecture_id") % 31 == 5, "LOST").otherwise(F.col("status")),
    })
    jobs = t.jobs(spark, sf_dir).withColumns({
        "current_stage": F.when(F.col("job_id") % 7 > 0, "CHUNKING").otherwise("NOWHERE"), "error_message": F.repeat(F.lit("e"), (F.col("job_id") % 1100).cast("int")), "status_detail": F.lit(None).cast("string"),
        "lease_owner": F.when(F.col("job_id") % 3 > 0, "w"), "max_attempts": (F.col("job_id") % 4).cast("int"), "lecture_id": F.expr("lecture_id div 3"),
    })
    runs = t.stage_runs(spark, sf_dir).withColumn("attempt", F.lit(1))
    chunks = t.chunks(spark, sf_dir).withColumns({
        "text": F.repeat(F.lit("w"), (F.col("chunk_id") % 5).cast("int")), "first_segment": F.col("chunk_id") % 4, "last_segment": F.col("chunk_id") % 6, "token_estimate": F.col("chunk_id") % 8,
        "embedding": F.when(F.col("chunk_id") % 10 > 0, F.col("embedding")), "sequence": F.col("chunk_id") % 200 - 1,
    })
    return constraints.report({"lectures": lec, "jobs": jobs, "stage_runs": runs, "chunks": chunks, "questions": t.chat_logs(spark, sf_dir)})


def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each user with questions from events: which rules each breaks."""
    logs = t.chat_logs(spark, sf_dir)
    key = F.concat(F.lit("d"), "user_id").alias("dataset_id")
    span = F.struct(F.col("search_ms").cast("double").alias("start_seconds"), (F.col("search_ms") + F.col("question_id") % 20 - 1).cast("double").alias("end_seconds"))
    questions = logs.select(key, F.expr("cast(question_id - pmod(question_id, 40) div 39 AS string)").alias("question_id"), F.pmod("lecture_id", F.lit(13)).cast("string").alias("lecture_key"), "answerable", F.when(F.col("k") % 3 > 0, F.array(span)).alias("gold_spans"), F.col("answer").alias("reference_answer"))
    lectures = logs.select(key, F.pmod("lecture_id", F.lit(12)).cast("string").alias("lecture_key")).distinct()
    datasets = logs.groupBy(key).agg((F.max("question_id") % 3).alias("x")).select("dataset_id", F.get(F.array(F.lit("dev"), F.lit("train"), F.lit("test")), F.col("x").cast("int")).alias("split"), (F.col("x") == 2).alias("frozen"), F.lit(None).cast("timestamp").alias("frozen_at"))
    return constraints.dataset_problems(datasets, lectures, questions).groupBy("dataset_id", "problem").agg(F.count("*").alias("n"))


_SEES = "(values " + ", ".join(f"('{c}')" for c in CALLERS) + ") c(caller)"
_CONFIGS = ", ".join(f"('{c}', {6 if k is None else k}, {s}::double, {2400 if b is None else b})" for c, k, s, b in SWEEPS)
_GONE = "select doc_id as lecture_id from documents where doc_id % 7 = 3"
_KEYS = "[" + ", ".join(f"'{k}'" for k in [*ablation.OVERRIDABLE, "database_url"]) + "]"
_TYPES = {"int": "integer", "double": "double", "string": "varchar"}
_OF_TYPE = ", ".join(f"max(case when key = '{k}' then try_cast(case when '{v}' <> 'int' or regexp_matches(raw, '^[0-9]+$') then raw end as {_TYPES[v]}) end) as {k}" for k, v in ablation.OVERRIDABLE.items())
ORACLE_SQL = {
    "secured_tables": f"""{with_sql("lectures", "chunks", "segments", "jobs", "chat_logs")}, own as (select caller, lecture_id from lectures join {_SEES} on user_id = caller),
      x as (select caller, 'my_lectures' as source, lecture_id from own union all select caller, 'my_questions', q.lecture_id from chat_logs q join {_SEES} on 'src' || (q.lecture_id % 20) = caller union all
        select caller, 'my_chunks', lecture_id from chunks join own using (lecture_id) union all select caller, 'my_segments', lecture_id from segments join own using (lecture_id) union all select caller, 'my_jobs', lecture_id from jobs join own using (lecture_id)),
      n as (select unnest(['my_lectures', 'my_questions', 'my_chunks', 'my_segments', 'my_jobs']) as source)
      select c.caller, n.source, count(x.lecture_id) as n, min(lecture_id) as first, max(lecture_id) as last from {_SEES} cross join n left join x on x.caller = c.caller and x.source = n.source group by all""",
    "cascade_delete": f"""{with_sql("lectures", "chunks", "segments", "jobs", "stage_runs")}, g as ({_GONE}), gj as (select job_id from jobs where lecture_id in (from g))
      select 'lectures' as table_name, count(*) as n_left from lectures where lecture_id not in (from g) union all select 'chunks', count(*) from chunks where lecture_id not in (from g) union all
      select 'segments', count(*) from segments where lecture_id not in (from g) union all select 'jobs', count(*) from jobs where lecture_id not in (from g) union all select 'stage_runs', count(*) from stage_runs where job_id not in (from gj)""",
    "failed_lectures": f"""{with_sql("lectures", "jobs")}, e as (select distinct lecture_id from jobs where status = 'running' and lease_expires_at < timestamp '{NOW}' and attempt_count >= 2)
      select lecture_id, case when e.lecture_id is not null and status not in ('READY', 'FAILED') then 'FAILED' else status end as status from lectures left join e using (lecture_id)""",
    "manual_retry": f"""{with_sql("lectures", "jobs")}, j as (select lecture_id, attempt_count, max_attempts, next_attempt_at, status in ('running', 'succeeded') and job_id % 3 > 0 as f, case when status in ('running', 'succeeded') and job_id % 3 > 0 then job_id % 4 > 0 end as r,
        case when status in ('running', 'succeeded') and job_id % 3 > 0 then 'failed' else status end as s from jobs),
      a as (select l.lecture_id, l.status, j.*, case when l.lecture_id % 5 = 0 or s is null then 'not_found' when not f then 'not_failed' when not r then 'not_retryable' else 'retried' end as answer from lectures l left join j on j.lecture_id = l.lecture_id)
      select lecture_id, answer, case when answer = 'retried' and status = 'FAILED' then 'QUEUED' else status end as status, case when answer = 'retried' then 'queued' else s end as job_status,
      case when answer = 'retried' then attempt_count + 3 else max_attempts end as max_attempts, case when answer = 'retried' then timestamp '{NOW}' else next_attempt_at end as next_attempt_at, case when answer <> 'retried' then r end as retryable from a""",
    "override_check": f"""with r as (select doc_id // 8 as config, ({_KEYS})[doc_id % 8 + 1] as key, trim(case doc_id % 3 when 0 then cast(n_chars as varchar) when 1 then ' ' || cast(n_chars / 16 as varchar) else source end) as raw from documents)
      select config, {_OF_TYPE}, array_to_string(list_sort(coalesce(list(distinct key) filter (where key = 'database_url' or (key in ('rag_top_k', 'rag_context_tokens', 'rag_max_output_tokens') and not regexp_matches(raw, '^[0-9]+$'))
        or (key in ('rag_min_similarity', 'llm_temperature') and try_cast(raw as double) is null)), [])), ',') as refused from r group by config""",
    "ablation_grid": rf"""{search._SIM}, c as (select * from (values {_CONFIGS}) v(config, k, least, budget), (values (true), (false)) a(use_threshold), (values (true), (false)) b(use_answerable), (values (true), (false)) d(require_citations)),
      r as (select s.*, {search._RANK} as rank from s), x as (select r.*, cast(greatest(1, ceil(len(regexp_extract_all(text, '\S+')) * 1.3::double)) as integer) as token_estimate from r join documents on chunk_id = doc_id where rank <= {MOST}),
      m as (select c.*, x.query_id, x.chunk_id, sum(token_estimate) over w as used, row_number() over w as nth from x join c on rank <= k and (not use_threshold or similarity >= least) window w as (partition by config, use_threshold, use_answerable, require_citations, query_id order by similarity desc, sequence rows unbounded preceding)),
      p as (select config, use_threshold, use_answerable, require_citations, query_id, count(*) as n from m where used <= budget or nth = 1 group by all),
      e as (select c.config, c.use_threshold, c.use_answerable, c.require_citations, p.n, case when n is null then 'below_threshold' when q.query_id % 7 = 0 or (c.use_answerable and q.query_id % 3 = 0) then 'model_declined'
        when c.require_citations and not (q.query_id // 50 % 5 between 1 and n) then 'no_valid_citations' else 'answered' end as decision
        from c cross join q left join p on p.config = c.config and p.use_threshold = c.use_threshold and p.use_answerable = c.use_answerable and p.require_citations = c.require_citations and p.query_id = q.query_id)
      select config, use_threshold, use_answerable, require_citations, count(*) as n_questions, coalesce(sum(n), 0) as n_passages, count(*) filter (where decision = 'answered') as n_answered, count(*) filter (where decision = 'below_threshold') as n_below_threshold,
      count(*) filter (where decision = 'model_declined') as n_model_declined, count(*) filter (where decision = 'no_valid_citations') as n_no_valid_citations from e group by all""",
    "constraint_report": f"""{with_sql("lectures", "jobs", "stage_runs", "chunks", "chat_logs")},
      l as (select *, case when lecture_id % 50 = 1 then 61 else 1 end * length(subject) as instructor_length, (source_type = 'url') <> (lecture_id % 9 = 0) as has_url, case when lecture_id % 4 > 0 then lecture_id % 97 end as request from lectures),
      c as (select chunk_id, lecture_id, chunk_id % 200 - 1 as sequence from chunks),
      x(table_name, rule, n) as (
        select 'lectures', unnest(['user_id_present', 'title_present', 'title_length', 'subject_length', 'topic_length', 'instructor_length', 'source_type', 'source_url_length', 'source_url_matches_type', 'status', 'duration']),
          unnest([count(*) filter (where user_id is null), count(*) filter (where title is null), count(*) filter (where length(trim(title)) not between 1 and 300), count(*) filter (where length(subject) > 120), count(*) filter (where length(topic) > 200),
            count(*) filter (where instructor_length > 120), count(*) filter (where source_type not in ('video', 'audio', 'url')), 0, count(*) filter (where (source_type = 'url') <> has_url), count(*) filter (where lecture_id % 31 = 5), count(*) filter (where duration_seconds < 0)]) from l
        union all select 'lectures', 'unique user_id, client_request_id', count(*) - count(distinct (user_id, request)) from l where user_id is not null and request is not null
        union all select 'lectures', 'unique user_id, source_fingerprint', count(*) - count(distinct (user_id, title)) from l where user_id is not null and title is not null
        union all select 'jobs', unnest(['status', 'current_stage', 'attempt_count', 'max_attempts', 'error_message_length', 'status_detail_length', 'running_has_lease']),
          unnest([0, count(*) filter (where job_id % 7 = 0), count(*) filter (where attempt_count < 0), count(*) filter (where job_id % 4 = 0), count(*) filter (where job_id % 1100 > 1000), 0, count(*) filter (where status = 'running' and (job_id % 3 = 0 or lease_expires_at is null))]) from jobs
        union all select 'jobs', 'unique lecture_id', count(*) - count(distinct job_id // 3) from jobs
        union all select 'stage_runs', unnest(['status', 'stage', 'attempt', 'duration']), unnest([0, count(*) filter (where stage is null), 0, count(*) filter (where duration_ms < 0)]) from stage_runs
        union all select 'stage_runs', 'unique job_id, stage, attempt', count(*) - count(distinct (job_id, stage)) from stage_runs where stage is not null
        union all select 'chunks', unnest(['sequence', 'text_length', 'start', 'time_order', 'segment_order', 'token_estimate', 'embedding_has_model']),
          unnest([count(*) filter (where chunk_id % 200 = 0), count(*) filter (where chunk_id % 5 = 0), count(*) filter (where start_seconds < 0), 0, count(*) filter (where chunk_id % 6 < chunk_id % 4), count(*) filter (where chunk_id % 8 = 0), count(*) filter (where chunk_id % 10 = 0)]) from chunks
        union all select 'chunks', 'unique lecture_id, sequence', count(*) - count(distinct (lecture_id, sequence)) from c
        union all select 'questions', unnest(['question_length', 'outcome', 'answer_length', 'search_ms', 'llm_ms', 'latency_present', 'latency_ms']),
          unnest([count(*) filter (where length(question) not between 1 and 1000), 0, count(*) filter (where length(answer) > 8000), count(*) filter (where search_ms < 0), count(*) filter (where llm_ms < 0), count(*) filter (where latency_ms is null), count(*) filter (where latency_ms < 0)]) from chat_logs)
      select * from x""",
    "dataset_problems": f"""{with_sql("chat_logs")}, q as (select 'd' || user_id as dataset_id, question_id - question_id % 40 // 39 as qid, lecture_id, answerable, k % 3 > 0 as gold, question_id % 20 - 1 as len, search_ms, coalesce(trim(answer), '') = '' as blank from chat_logs),
      l as (select distinct dataset_id, lecture_id % 12 as lecture_key from q), d as (select 'd' || user_id as dataset_id, max(question_id) % 3 as x from chat_logs group by 1),
      p as (select dataset_id, 'answerable_without_gold' as problem from q where answerable and (not gold or blank) union all select dataset_id, 'unanswerable_with_gold' from q where not answerable and gold
        union all select dataset_id, 'span_order' from q where gold and (len <= 0 or search_ms < 0) union all select q.dataset_id, 'unknown_lecture' from q where not exists (select 1 from l where l.dataset_id = q.dataset_id and l.lecture_key = q.lecture_id % 13)
        union all select dataset_id, 'repeated_question' from q group by dataset_id, qid having count(*) > 1 union all select dataset_id, 'split' from d where x = 1 union all select dataset_id, 'frozen_without_time' from d where x = 2)
      select dataset_id, problem, count(*) as n from p group by all""",
}
QUERIES = {f.__name__: f for f in (secured_tables, cascade_delete, failed_lectures, manual_retry, override_check, ablation_grid, constraint_report, dataset_problems)}
