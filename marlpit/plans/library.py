"""Library, history and dashboard queries, for every owner at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.operators import jobs as job_ops
from marlpit.operators import documents, library
from marlpit.schema import STAGES
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql

PAGE = 20


def _page(sort: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return library.pages(t.lectures(spark, sf_dir), sort, PAGE).select("user_id", "place", "lecture_id", "total")

    return query


def _page_sql(order: str) -> str:
    return f"""{with_sql("lectures")}, r as (select *, row_number() over (partition by user_id order by {order}) as place, count(*) over (partition by user_id) as total from lectures)
    select user_id, place, lecture_id, total from r where place <= {PAGE}"""


def library_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.pages(t.lectures(spark, sf_dir), "newest", PAGE, offset=PAGE).select("user_id", "place", "lecture_id", "total")


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(t.lectures(spark, sf_dir), " The ").select("lecture_id", "user_id", "subject")


def library_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.lectures(spark, sf_dir).groupBy("user_id", library.status_group().alias("status_group")).agg(F.count("*").alias("n"))


def subjects_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.distinct_subjects(t.lectures(spark, sf_dir)).orderBy(F.lower("subject"), "subject")


def lecture_with_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = library.with_job(t.lectures(spark, sf_dir), t.jobs(spark, sf_dir))
    return out.select("lecture_id", "user_id", F.col("job.job_id").alias("job_id"), F.col("job.status").alias("job_status"), F.col("job.attempt_count").alias("attempts"))


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = library.history(t.chat_logs(spark, sf_dir), t.lectures(spark, sf_dir), " Click ", PAGE)
    return out.select("user_id", "place", "question_id", "lecture_id", "total")


def dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.dashboard(t.lectures(spark, sf_dir), t.chat_logs(spark, sf_dir))


def visible_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of READY lectures, counted: children reached through their lecture."""
    ready = t.lectures(spark, sf_dir).where("status = 'READY'")
    return library.children(t.segments(spark, sf_dir), ready).groupBy("lecture_id").agg(F.count("*").alias("n_segments"))


def processing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job with its stage runs as one ordered array, as text."""
    runs = t.stage_runs(spark, sf_dir).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("started_at", "stage", "status", "tie", "tie2"))).alias("runs"))
    stages = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["stage"], r["status"])), ",")
    return t.jobs(spark, sf_dir).join(runs, "job_id", "left").select("job_id", "status", stages.alias("stages"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"))


def lecture_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lectures with the number of their segments, chunks and questions: each side aggregated before it is joined."""
    lec = t.lectures(spark, sf_dir).select("lecture_id", "user_id")
    for name, df in (("n_segments", t.segments(spark, sf_dir)), ("n_chunks", t.chunks(spark, sf_dir)), ("n_questions", t.chat_logs(spark, sf_dir))):
        lec = lec.join(df.groupBy("lecture_id").agg(F.count("*").alias(name)), "lecture_id", "left")
    return lec.fillna(0, ["n_segments", "n_chunks", "n_questions"])


def _texts(rows: str, *fields: str):
    """An array of structs as one text."""
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[F.coalesce(r[f].cast("string"), F.lit("-")) for f in fields])), ";")


def processing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lecture's processing page, its lists as texts. Media are made of the lectures: an original, and audio once it is READY."""
    lec = t.lectures(spark, sf_dir)
    kinds = F.explode(F.when(F.col("status") == "READY", F.array(F.lit("original"), F.lit("audio"))).otherwise(F.array(F.lit("original"))))
    media = lec.select("lecture_id", kinds.alias("kind"), "source_type", "duration_seconds").select("lecture_id", "kind", F.concat_ws("/", "source_type", "kind").alias("mime_type"), (F.col("duration_seconds") * 48).alias("file_size"))
    runs = t.stage_runs(spark, sf_dir).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))
    out = documents.processing_pages(lec, t.jobs(spark, sf_dir), runs, media, STAGES[:6])
    return out.select(
        "lecture_id", F.col("lecture.status").alias("status"), F.col("job.status").alias("job_status"), _texts("stage_runs", "started_at", "stage", "status", "duration_ms").alias("runs"),
        _texts("media", "kind", "mime_type", "file_size").alias("media"), F.size("implemented_stages").alias("n_stages"),
    )


def workspace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lecture's workspace, its lists as texts: segments are turns, a third of them emptied; chapters begin at every fourth turn."""
    seg = t.segments(spark, sf_dir).withColumn("text", F.when(F.col("sequence") % 3 < 2, F.col("raw_text")).otherwise(" \n "))
    transcripts = seg.groupBy("lecture_id").agg(F.lit("en").alias("language"))
    chapters = seg.where("sequence % 4 = 0").withColumn("title", F.concat(F.lit("from "), "sequence"))
    out = documents.workspace_pages(t.lectures(spark, sf_dir), transcripts, seg, chapters, t.chunks(spark, sf_dir))
    return out.select(
        "lecture_id", F.col("lecture.title").alias("title"), F.col("transcript.language").alias("language"), F.sha2(_texts("transcript.segments", "sequence", "start", "end", "text"), 256).alias("segments_sha256"),
        _texts("chapters", "sequence", "title", "end").alias("chapters"), F.size("chunks").cast("long").alias("n_chunks"), F.get("chunks", 0)["start"].alias("first_chunk_start"),
    )


def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lec = t.lectures(spark, sf_dir).where("duration_seconds is not null")
    return lec.select("lecture_id", tx.clock(F.col("duration_seconds")).alias("clock"), tx.clock(F.col("duration_seconds"), pad=False).alias("short_clock"))


def tags_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of a title as tags: first spelling kept, case aside, in order."""
    words = F.filter(F.split("title", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tags = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return t.lectures(spark, sf_dir).select("lecture_id", F.array_join(F.slice(tags, 1, 20), "|").alias("tags"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.highlight_terms(F.col("text")), " ").alias("terms"))


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select(
        "page_id",
        F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"),
        F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"),
        F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"),
        F.concat(F.lit("page:"), F.regexp_extract("url", r"/(\d+)(?:[.?#]|$)", 1)).alias("fingerprint"),
    )


def metadata_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lec = t.lectures(spark, sf_dir)
    rules = {"title_length": "length(title) between 1 and 300", "subject": "length(trim(subject)) between 1 and 120", "duration": "duration_seconds is null or duration_seconds <= 14400", "status": "status in ('READY','FAILED','EMBEDDING')"}
    broken = F.explode(F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), name) for name, rule in rules.items()]), lambda x: x.isNotNull()))
    return lec.select(broken.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def uniqueness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Succeeded jobs overwritten by a newer row each, all others as they were."""
    jobs = t.jobs(spark, sf_dir).select("job_id", "status", "attempt_count")
    new = jobs.where("status = 'succeeded'").select("job_id", F.lit("failed").alias("status"), (F.col("attempt_count") + 1).alias("attempt_count"))
    return job_ops.upsert(jobs, new, ["job_id"])


_L = with_sql("lectures")
ORACLE_SQL = {
    "library_page_newest": _page_sql("created_at desc, lecture_id desc"),
    "library_page_oldest": _page_sql("created_at, lecture_id"),
    "library_page_title": _page_sql("title, created_at desc, lecture_id desc"),
    "library_duration_nulls_last": _page_sql("duration_seconds desc nulls last, created_at desc, lecture_id desc"),
    "library_second_page": _page_sql("created_at desc, lecture_id desc").replace(f"place <= {PAGE}", f"place > {PAGE} and place <= {2 * PAGE}"),
    "library_search": f"{_L} select lecture_id, user_id, subject from lectures where contains(lower(title || ' ' || subject || ' ' || topic), 'the')",
    "library_status_counts": f"{_L} select user_id, case status when 'READY' then 'ready' when 'FAILED' then 'failed' else 'processing' end as status_group, count(*) as n from lectures group by all",
    "subjects_distinct": f"{_L} select subject, count(*) as n_lectures from lectures where trim(subject) <> '' group by subject",
    "lecture_with_job": f"{with_sql('lectures', 'jobs')} select l.lecture_id, user_id, job_id, j.status as job_status, attempt_count as attempts from lectures l left join jobs j using (lecture_id)",
    "history_search": f"""{with_sql("lectures", "chat_logs")}, f as (select *, row_number() over (partition by user_id order by created_at desc, question_id desc) as place, count(*) over (partition by user_id) as total
      from chat_logs where contains(lower(question), 'click') or coalesce(contains(lower(answer), 'click'), false))
      select f.user_id, place, question_id, lecture_id, total from f join lectures using (lecture_id) where place <= {PAGE}""",
    "dashboard_overview": f"""{with_sql("lectures", "chat_logs")}, r as (select *, row_number() over (partition by user_id, status = 'READY' order by created_at desc, lecture_id desc) as nth from lectures),
      q as (select l.user_id, count(*) as n from chat_logs c join lectures l using (lecture_id) group by 1)
      select user_id, count(*) as n_lectures, cast(coalesce(sum(case when status = 'READY' and nth <= 100 then coalesce(duration_seconds, 0) else 0 end), 0) as bigint) as ready_seconds,
      count(*) filter (where status = 'READY') > 100 as ready_is_partial,
      count(*) filter (where status not in ('READY', 'FAILED')) as n_processing, count(*) filter (where status = 'FAILED') as n_failed, coalesce(max(q.n), 0) as n_questions from r left join q using (user_id) group by user_id""",
    "visible_children": f"{with_sql('lectures', 'segments')} select lecture_id, count(*) as n_segments from segments where lecture_id in (select lecture_id from lectures where status = 'READY') group by lecture_id",
    "processing_details": f"""{with_sql("jobs", "stage_runs")}, r as (select job_id, string_agg(stage || ':' || status, ',' order by started_at, stage, status, tie, tie2) as stages, count(*) as n_runs from stage_runs group by job_id)
      select j.job_id, j.status, stages, coalesce(n_runs, 0) as n_runs from jobs j left join r using (job_id)""",
    "lecture_assembly": f"""{with_sql("lectures", "segments", "chunks", "chat_logs")} select l.lecture_id, l.user_id, coalesce(s.n, 0) as n_segments, coalesce(c.n, 0) as n_chunks, coalesce(q.n, 0) as n_questions from lectures l
      left join (select lecture_id, count(*) n from segments group by 1) s using (lecture_id) left join (select lecture_id, count(*) n from chunks group by 1) c using (lecture_id) left join (select lecture_id, count(*) n from chat_logs group by 1) q using (lecture_id)""",
    "clock_format": f"""{_L}, d as (select lecture_id, duration_seconds as s from lectures where duration_seconds is not null)
      select lecture_id, case when s >= 3600 then format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) else format('{{:02d}}:{{:02d}}', s // 60, s % 60) end as clock,
      case when s >= 3600 then format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s % 3600 // 60, s % 60) else format('{{}}:{{:02d}}', s // 60, s % 60) end as short_clock from d""",
    "tags_clean": rf"""{_L}, w as (select lecture_id, list_filter(regexp_split_to_array(title, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from lectures),
      e as (select lecture_id, unnest(ws) as w, unnest(range(len(ws))) as pos from w), f as (select lecture_id, min(pos) as pos, arg_min(w, pos) as w from e group by lecture_id, lower(w)),
      n as (select *, row_number() over (partition by lecture_id order by pos) as nth from f), g as (select lecture_id, string_agg(w, '|' order by pos) as tags from n where nth <= 20 group by lecture_id)
      select lectures.lecture_id, coalesce(tags, '') as tags from lectures left join g using (lecture_id)""",
    "search_terms": r"""with w as (select item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) as w, unnest(range(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')))) as pos from benchmark),
      f as (select item_id, w, min(pos) as pos from w where w not in ('what','when','where','which','does','with','that','this','from','about','there','their','have','into','they','lecture') group by all),
      n as (select *, row_number() over (partition by item_id order by pos) as nth from f), g as (select item_id, string_agg(w, ' ' order by pos) as terms from n where nth <= 6 group by item_id)
      select benchmark.item_id, coalesce(terms, '') as terms from benchmark left join g using (item_id)""",
    "url_parse": r"""select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path,
      nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, 'page:' || regexp_extract(url, '/(\d+)(?:[.?#]|$)', 1) as fingerprint from pages""",
    "metadata_violations": f"""{_L} select rule, count(*) as n from (
      select 'title_length' as rule from lectures where not coalesce(length(title) between 1 and 300, false) union all select 'subject' from lectures where not coalesce(length(trim(subject)) between 1 and 120, false)
      union all select 'duration' from lectures where not (duration_seconds is null or duration_seconds <= 14400) union all select 'status' from lectures where status not in ('READY','FAILED','EMBEDDING')) group by rule""",
    "uniqueness_report": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "processing_pages": f"""{with_sql("lectures", "jobs", "stage_runs")}, r as (select job_id, string_agg(concat_ws(':', strftime(started_at, '%Y-%m-%d'), stage, status, coalesce(cast(duration_ms as varchar), '-')), ';' order by strftime(started_at, '%Y-%m-%d'), stage, status nulls first, duration_ms nulls first) as runs from stage_runs group by job_id)
      select l.lecture_id, l.status, j.status as job_status, coalesce(runs, '') as runs, case when l.status = 'READY' then 'audio:' || source_type || '/audio:' || coalesce(cast(duration_seconds * 48 as varchar), '-') || ';' else '' end
        || 'original:' || source_type || '/original:' || coalesce(cast(duration_seconds * 48 as varchar), '-') as media, 6 as n_stages from lectures l left join jobs j on j.lecture_id = l.lecture_id left join r on r.job_id = j.job_id""",
    "workspace_pages": f"""{with_sql("lectures", "segments", "chunks")}, s as (select lecture_id, string_agg(sequence || ':' || start_seconds || ':' || end_seconds || ':' || raw_text, ';' order by sequence, start_seconds, end_seconds, raw_text) as txt from segments where sequence % 3 < 2 and trim(regexp_replace(coalesce(raw_text, ''), '\\s+', ' ', 'g')) <> '' group by 1),
      c as (select lecture_id, string_agg(sequence || ':from ' || sequence || ':' || end_seconds, ';' order by sequence) as chapters from segments where sequence % 4 = 0 group by 1), k as (select lecture_id, count(*) as n, min_by(start_seconds, sequence) as first from chunks group by 1), h as (select distinct lecture_id from segments)
      select l.lecture_id, title, case when h.lecture_id is not null then 'en' end as language, case when h.lecture_id is not null then sha256(coalesce(txt, '')) end as segments_sha256, coalesce(chapters, '') as chapters, coalesce(n, 0) as n_chunks, first as first_chunk_start
      from lectures l left join h using (lecture_id) left join s using (lecture_id) left join c using (lecture_id) left join k using (lecture_id)""",
    "upsert_jobs": f"{with_sql('jobs')} select job_id, case when status = 'succeeded' then 'failed' else status end as status, attempt_count + case when status = 'succeeded' then 1 else 0 end as attempt_count from jobs",
}
QUERIES = {
    "library_page_newest": _page("newest"),
    "library_page_oldest": _page("oldest"),
    "library_page_title": _page("title"),
    "library_duration_nulls_last": _page("duration"),
} | {
    f.__name__: f
    for f in (
        library_second_page, library_search, library_status_counts, subjects_distinct, lecture_with_job, history_search, dashboard_overview, visible_children, processing_details,
        lecture_assembly, processing_pages, workspace_pages, clock_format, tags_clean, search_terms, url_parse, metadata_violations, uniqueness_report, upsert_jobs,
    )
}
