"""Job lifecycle, limits and clean-up. The time of day is a literal, so that every run is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.operators import jobs as ops
from marlpit.schema import LECTURE_STATUSES, RATE_LIMIT, RATE_WINDOW, STAGES
from marlpit.sources import files
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql
from marlpit.streaming import leases, live
from marlpit.streaming.queue import JobQueue

NOW = "1998-06-01 00:00:00"


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.claim(t.jobs(spark, sf_dir), _now())


def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recover(t.jobs(spark, sf_dir), _now())


def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.backoff(t.jobs(spark, sf_dir).where("status = 'running'"), _now())


def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stuck(t.jobs(spark, sf_dir), _now()).groupBy("kind").agg(F.count("*").alias("n"), F.min("job_id").alias("first_job"))


def _staged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a current stage: by job_id, and some of them waiting or failed."""
    stage = F.get(F.array(*map(F.lit, STAGES)), F.expr("cast(pmod(job_id, 7) AS int)"))
    status = F.when((F.col("status") == "queued") & (F.col("job_id") % 5 == 0), "waiting").when((F.col("status") == "running") & (F.col("job_id") % 5 == 1), "failed").otherwise(F.col("status"))
    return t.jobs(spark, sf_dir).withColumns({"current_stage": stage, "status": status})


def stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs show each state of each stage, and the time of the runs shown."""
    out = ops.stage_states(_staged_jobs(spark, sf_dir), t.stage_runs(spark, sf_dir))
    return out.groupBy("stage", "state").agg(F.count("*").alias("n"), F.count("duration_ms").alias("n_timed"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("ms"))


def resume_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resume_waiting(_staged_jobs(spark, sf_dir), STAGES[:5], _now()).select("job_id", "status", "next_attempt_at", "resumed")


def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.due_jobs(t.jobs(spark, sf_dir), _now())


def stage_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three jobs report an outcome, some for a stage they have left."""
    jobs = _staged_jobs(spark, sf_dir)
    seen = F.get(F.array(*map(F.lit, STAGES)), F.expr("cast(pmod(job_id + case when pmod(job_id, 11) = 0 then 1 else 0 end, 7) AS int)"))
    outcome = F.element_at(F.array(F.lit("succeeded"), F.lit("failed"), F.lit("unavailable"), F.lit("succeeded")), F.expr("cast(pmod(job_id, 4) AS int) + 1"))
    done = jobs.where("pmod(job_id, 3) > 0").select("job_id", seen.alias("expected_stage"), outcome.alias("outcome"))
    return ops.advance(jobs, done).select("job_id", "status", "current_stage", "won")


def lecture_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as changes of lecture status, legal or not, counted."""
    names = F.array(*map(F.lit, LECTURE_STATUSES))
    at = lambda x: F.get(names, F.expr(f"cast(pmod({x}, {len(LECTURE_STATUSES)}) AS int)"))
    s = t.table(spark, sf_dir, "documents").select(at("doc_id").alias("before"), at(f"doc_id div {len(LECTURE_STATUSES)}").alias("after"))
    return ops.lecture_moves(s).groupBy("before", "after", "legal").agg(F.count("*").alias("n"))


def transition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive runs of a job as status changes, legal or not."""
    from pyspark.sql import Window

    names = F.when(F.col("status") == "running", "running").otherwise(F.col("status"))
    order = Window.partitionBy("job_id").orderBy("started_at", "stage", "tie", "tie2", "status", F.col("duration_ms").asc_nulls_first())
    runs = t.stage_runs(spark, sf_dir).withColumn("after", names).withColumn("before", F.lag(names).over(order)).where("before is not null")
    return ops.legal_moves(runs.select("job_id", "before", "after")).groupBy("before", "after", "legal").agg(F.count("*").alias("n"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from events: owner/lecture/event, some with a wrong owner, some at the top, some that no lecture uses, some new or of unknown age."""
    logs = t.chat_logs(spark, sf_dir)
    owner = F.concat(F.lit("src"), F.expr("pmod(lecture_id + case when pmod(question_id, 6) = 0 then 1 else 0 end, 20)").cast("string"))
    path = F.concat_ws("/", owner, F.when(F.col("question_id") % 9 > 0, F.col("lecture_id").cast("string")), F.col("question_id").cast("string"))
    objects = logs.select(path.alias("path"), F.when(F.col("question_id") % 13 > 0, F.col("created_at")).alias("created_at"))
    used = logs.where("answerable").select(path.alias("path"))
    return ops.orphans(objects, t.lectures(spark, sf_dir), used, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).groupBy("reason").agg(F.count("*").alias("n"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.lit("all").alias("subject"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return ops.rate_limited(e, 2, RATE_WINDOW * RATE_LIMIT)


def dedupe_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every fingerprint; each eleventh document has none."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 > 0, F.sha2("text", 256)).alias("fingerprint"))
    return ops.first_submissions(d, "fingerprint", "doc_id").select("doc_id", "fingerprint")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of activity of every user: gaps of six hours end them."""
    e = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    out = live.presence(e, ttl="6 hours")
    return out.select("worker", F.col("from").cast("timestamp_ntz").alias("from"), F.col("until").cast("timestamp_ntz").alias("until"), "n")


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("user_id").alias("subject"), F.col("ts").cast("timestamp").alias("at"))
    return live.rate_counts(e, 3600).select("operation", "subject", F.col("from").cast("timestamp_ntz").alias("from"), "n")


def lease_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a command for its user's job, by one of three workers; leases last two days."""
    e = t.table(spark, sf_dir, "events")
    kinds = ["enqueue", "claim", "renew", "claim", "fail", "renew", "finish", "retry"]
    command = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64("event_id"), F.lit(len(kinds))) + 1).cast("int"))
    c = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), command.alias("command"), F.concat(F.lit("w"), F.pmod("event_id", F.lit(3))).alias("owner"), F.col("ts").cast("timestamp").alias("at"))
    return leases.lease_answers(c, lease_ms=2 * 86_400_000).withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("at", "first_started")})


def notification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notifications about their users: streamed into a queue, each user once, and taken in two takes."""
    queue = JobQueue(spark, files.work_dir(spark, "queue"))
    source = spark.readStream.schema(t.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as a plain path would have to be a folder
    notices = source.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"))
    queue.announce(notices, ttl="3650 days").awaitTermination()
    for take, most in (("first", 100), ("rest", 2_000_000_000)):
        queue.take(take, most)
    return queue.taken().groupBy("job_id").agg(F.count("*").alias("n_taken"))


_J = with_sql("jobs")
_R = with_sql("stage_runs")
_T = f"timestamp '{NOW}'"
_STAGED = """st as (select unnest(['EXTRACTING_AUDIO','TRANSCRIBING','CLEANING','CHUNKING','EMBEDDING','INDEXING','GENERATING_INTELLIGENCE']) as stage, unnest(range(7)) as pos),
j as (select job_id, next_attempt_at, job_id % 7 as cur, case when status = 'queued' and job_id % 5 = 0 then 'waiting' when status = 'running' and job_id % 5 = 1 then 'failed' else status end as status from jobs)"""
ORACLE_SQL = {
    "job_claim": f"""{_J}, h as (select *, status = 'queued' and next_attempt_at <= {_T} as hit from jobs) select job_id, case when hit then 'running' else status end as status, attempt_count + hit::integer as attempt_count,
      case when hit then {_T} + interval 120 seconds else lease_expires_at end as lease_expires_at, hit as claimed from h""",
    "job_recover": f"""{_J}, h as (select *, coalesce(status = 'running' and lease_expires_at < {_T}, false) as ex, coalesce(status = 'running' and lease_expires_at < {_T}, false) and attempt_count >= max_attempts as sp from jobs)
      select job_id, case when sp then 'failed' when ex then 'queued' else status end as status, case when ex and not sp then {_T} else next_attempt_at end as next_attempt_at, case when not ex then lease_expires_at end as lease_expires_at, case when sp then 'FAILED' end as lecture_status from h""",
    "job_backoff": f"""{_J}, h as (select job_id, case when attempt_count < max_attempts then cast(30 * pow(2, greatest(attempt_count - 1, 0)) as bigint) end as w from jobs where status = 'running')
      select job_id, w as wait_seconds, {_T} + to_seconds(w) as next_attempt_at from h""",
    "stuck_jobs": f"""{_J}, h as (select job_id, case when status = 'queued' and next_attempt_at < {_T} - interval 900 seconds then 'queued_overdue' when status = 'running' and queued_at < {_T} - interval 14400 seconds then 'long_running' end as kind from jobs)
      select kind, count(*) as n, min(job_id) as first_job from h where kind is not null group by kind""",
    "stage_state": f"""{with_sql("jobs", "stage_runs")}, {_STAGED}, n as (select *, row_number() over (partition by job_id, stage order by started_at desc, tie desc, tie2 desc, status desc, duration_ms desc nulls last) as nth from stage_runs),
      l as (select job_id, stage, duration_ms from n where nth = 1 and status = 'succeeded'),
      g as (select j.job_id, st.stage, case when status = 'succeeded' or pos < cur then 'done' when pos = cur then case status when 'running' then 'active' when 'queued' then 'queued' when 'waiting' then 'unavailable' when 'failed' then 'failed' else 'pending' end else 'pending' end as state from j cross join st)
      select g.stage, state, count(*) as n, count(duration_ms) as n_timed, cast(coalesce(sum(duration_ms), 0) as bigint) as ms from g left join l on l.job_id = g.job_id and l.stage = g.stage group by all""",
    "resume_waiting": f"""{_J}, {_STAGED} select job_id, case when status = 'waiting' and cur < 5 then 'queued' else status end as status, case when status = 'waiting' and cur < 5 then {_T} else next_attempt_at end as next_attempt_at,
      status = 'waiting' and cur < 5 as resumed from j""",
    "due_jobs": f"{_J} select job_id, next_attempt_at from jobs where status = 'queued' and next_attempt_at <= {_T} order by next_attempt_at, job_id limit 50",
    "stage_advance": f"""{_J}, {_STAGED}, d as (select *, case when job_id % 3 > 0 then (['succeeded', 'failed', 'unavailable', 'succeeded'])[job_id % 4 + 1] end as outcome, (job_id + case when job_id % 11 = 0 then 1 else 0 end) % 7 as seen from j),
      w as (select *, case when outcome is not null then status = 'running' and seen = cur end as won from d)
      select job_id, case when not coalesce(won, false) then status when outcome = 'failed' then 'failed' when outcome = 'unavailable' then 'waiting' when cur = 6 then 'succeeded' else 'running' end as status,
      (select stage from st where pos = case when coalesce(won, false) and outcome = 'succeeded' and cur < 6 then cur + 1 else cur end) as current_stage, won from w""",
    "lecture_transitions": """with s as (select unnest(['UPLOADED','QUEUED','EXTRACTING_AUDIO','TRANSCRIBING','CLEANING','CHUNKING','EMBEDDING','INDEXING','GENERATING_INTELLIGENCE','READY','FAILED']) as x, unnest(range(11)) as i)
      select a.x as before, b.x as after, a.i <> b.i and case when b.i = 10 then a.i < 9 when b.i = 1 then a.i in (0, 10) or a.i between 2 and 8 when a.i = 1 then b.i between 2 and 8 when a.i between 2 and 8 then b.i = a.i + 1 else false end as legal, count(*) as n
      from documents join s a on a.i = doc_id % 11 join s b on b.i = doc_id // 11 % 11 group by all""",
    "transition_report": f"""{_R}, b as (select job_id, status as after, lag(status) over (partition by job_id order by started_at, stage, tie, tie2, status, duration_ms nulls first) as before from stage_runs)
      select before, after, (before || '>' || after) in ('queued>running','running>succeeded','running>failed','running>queued','running>waiting','waiting>queued','failed>queued') as legal, count(*) as n from b where before is not null group by all""",
    "orphans": f"""{with_sql("chat_logs", "lectures")}, o as (select 'src' || ((lecture_id + case when question_id % 6 = 0 then 1 else 0 end) % 20) as owner, lecture_id, question_id % 9 > 0 as deep, answerable, case when question_id % 13 > 0 then created_at end as made from chat_logs)
      select case when made <= timestamp '2024-01-20' then case when not deep then 'unexpected_location' when l.lecture_id is null then 'lecture_missing' when owner <> user_id then 'owner_mismatch' when not answerable then 'unreferenced' end end as reason,
      count(*) as n from o left join lectures l using (lecture_id) group by 1""",
    "rate_limit": f"""with e as (select event_id as id, event_type, ts, cast(floor(epoch(ts)) as bigint) as s from events), w as (select *, s // {RATE_WINDOW * RATE_LIMIT} as win from e), n as (select *, row_number() over (partition by event_type, win order by ts, id) as n from w)
      select id, n, n <= 2 as allowed, greatest(2 - n, 0) as remaining, greatest(1, (win + 1) * {RATE_WINDOW * RATE_LIMIT} - s) as retry_after from n""",
    "dedupe_submissions": """with d as (select doc_id, case when doc_id % 11 > 0 then sha256(text) end as fingerprint from documents), n as (select *, row_number() over (partition by fingerprint order by doc_id) as nth from d)
      select doc_id, fingerprint from n where fingerprint is null or nth = 1""",
    "presence": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as s from events), r as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as run from g)
      select user_id as worker, min(ts) as "from", max(ts) + interval 6 hours as until, count(*) as n from r group by user_id, run""",
    "notification_queue": "select user_id as job_id, 1 as n_taken from events where user_id is not null group by user_id",
    "rate_windows": """select event_type as operation, user_id as subject, date_trunc('hour', ts) as "from", count(*) as n from events group by all""",
}
QUERIES = {f.__name__: f for f in (job_claim, job_recover, job_backoff, stuck_jobs, stage_state, resume_waiting, due_jobs, stage_advance, lecture_transitions, transition_report, orphans, rate_limit, dedupe_submissions, presence, rate_windows, lease_commands, notification_queue)}
