"""Formats, checks, writes and readers over the supplied tables. Values that these tables lack are made from ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import display as d
from marlpit.functions import text as tx
from marlpit.operators import checks, grounding, writes
from marlpit.schema import STAGES
from marlpit.sources import files
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    seconds, size, ms = F.floor(F.col("value") * 97), F.floor(F.pow(F.col("value"), F.lit(2.0)) * 90001).cast("long"), F.floor(F.col("value") * 20).cast("long")
    return e.select(
        "event_id", d.hours(seconds).alias("hours"), d.file_size(size).alias("size"), d.milliseconds(F.when(F.col("event_id") % 7 > 0, ms)).alias("ms"),
        d.deep_link(F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 > 0, F.col("value")), F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise("")).alias("link"),
    )


def client_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    header = F.when(F.col("event_id") % 4 == 0, "soon").when(F.col("event_id") % 4 == 1, F.col("user_id").cast("string"))
    return e.select(
        "event_id", d.retry_after(header).alias("retry_after"), d.clamp(F.when(F.col("event_id") % 9 > 0, (F.col("user_id") - 20).cast("long"))).alias("k"),
        d.page_count(F.col("user_id"), F.lit(12)).alias("n_pages"), d.playback_bitrate(F.floor(F.col("value") * 100).cast("double") - 100).alias("kbps"),
    )


def video_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of seven forms, some of them to no video."""
    name = F.lpad(F.col("doc_id").cast("string"), 11, "a_-")
    forms = ["https://www.youtube.com/watch?v=%s&t=9", " http://youtu.be/%s/x ", "https://m.youtube.com/shorts/%s", "https://youtube.com/embed/%s?a=b", "ftp://youtu.be/%s", "https://example.org/watch?v=%s", "https://youtu.be/x%s"]
    url = F.element_at(F.array(*[F.format_string(f, name) for f in forms]), F.expr("cast(pmod(doc_id, 7) AS int) + 1"))
    found = t.table(spark, sf_dir, "documents").select("doc_id", d.video_source(url).alias("video"))
    return found.withColumns({"fingerprint": F.concat(F.lit("youtube:"), "video"), "canonical": F.concat(F.lit("https://www.youtube.com/watch?v="), "video")})


def status_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of lecture and job status that the tables give, by number."""
    jobs = t.jobs(spark, sf_dir).select(F.col("job_id").alias("lecture_id"), F.when(F.col("job_id") % 5 == 0, "waiting").otherwise(F.col("status")).alias("job_status"), F.when(F.col("job_id") % 2 == 0, "timeout").alias("error"))
    out = t.lectures(spark, sf_dir).join(jobs, "lecture_id", "left")
    return out.select("status", "job_status", d.status_info(F.col("status"), F.col("job_status"), F.col("error"), STAGES).alias("i")).groupBy("status", "job_status", "i.grouping", "i.tone", "i.badge", "i.stage").agg(F.count("*").alias("n"))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.lectures(spark, sf_dir).select("lecture_id", d.cover_hue(F.col("title")).cast("long").alias("hue"), d.initials(F.substring(F.col("title"), 1, 40)).alias("initials"))


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, ids and names, every third one spoilt."""
    k = F.col("doc_id").cast("string")
    sha = F.concat(F.sha2("text", 256), F.when(F.col("doc_id") % 3 == 0, "0").otherwise(""))
    name = F.concat(F.lit("C:\\dir/"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" a\u0001b"), k, F.lit(".mp3 "))).otherwise(""))
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", sha.rlike(d.SHA256).alias("is_sha256"), F.lpad(k, 11, "x").rlike(d.VIDEO_ID).alias("is_video"), F.concat(F.lit("req-"), k).rlike(d.REQUEST_ID).alias("is_request"), d.safe_name(name).alias("name"),
        d.object_path(F.col("source"), k, F.lit("original"), F.coalesce(d.safe_name(name), F.lit("file"))).alias("path"), d.iso_time(F.concat(F.lit("2024-0"), (F.col("doc_id") % 12).cast("string"), F.lit("-03"))).cast("timestamp_ntz").alias("day"),
    )


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = d.highlight_parts(F.col("text"), " Ion ")
    out = t.table(spark, sf_dir, "benchmark").select("item_id", "text", parts.alias("p"))
    return out.select("item_id", F.size(F.filter("p", lambda x: x["match"])).cast("long").alias("n_matches"), F.size("p").cast("long").alias("n_parts"), (F.array_join("p.text", "") == F.col("text")).alias("whole"))


def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ["ERROR: Private video.", "Join: Members-only", "Sign in to confirm your age", "you're not a bot", "Not available in your country", "Copyright claim, private video", "This live event will begin", "Video unavailable", "gone"]))
    return t.table(spark, sf_dir, "events").groupBy(d.restriction(F.get(said, F.expr("cast(pmod(event_id, 9) AS int)"))).alias("code")).agg(F.count("*").alias("n"))


def media_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original where there is one, else the playback; a video only if an uploaded one has a picture."""
    media = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("original").alias("kind"), F.lit(1).alias("nth")), F.struct(F.lit("playback").alias("kind"), F.lit(2).alias("nth")))).alias("m"))
    media = media.where("(m.nth = 1 and pmod(doc_id, 4) > 0) or (m.nth = 2 and pmod(doc_id, 5) > 0)")
    best = media.groupBy(F.col("doc_id").alias("lecture_id")).agg(F.min_by("m.kind", "m.nth").alias("kind"))
    picture = F.coalesce(F.when(F.col("lecture_id") % 2 == 0, F.col("lecture_id") % 6 > 0), F.lit(True))
    out = t.lectures(spark, sf_dir).join(best, "lecture_id", "left")
    shown = F.when(F.col("kind").isNull(), "media_unavailable").when((F.col("kind") == "original") & (F.col("source_type") == "video") & picture, "video").otherwise("audio")
    return out.select("lecture_id", shown.alias("shown"))


def media_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "video").otherwise("audio").alias("kind"), (F.col("event_id") % 11 > 0).alias("has_audio"), F.floor(F.col("value") * 200 - 500).cast("long").alias("seconds"), F.floor(F.col("value") * 9e6).cast("long").alias("bytes"))
    return checks.media_problems(rows)


def object_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that their path's owner may see: the first part is the caller, the second one of the caller's lectures."""
    path = F.concat_ws("/", F.concat(F.lit("src"), F.expr("pmod(question_id, 20)").cast("string")), F.col("lecture_id").cast("string"), F.col("question_id").cast("string"))
    objects = t.chat_logs(spark, sf_dir).select(path.alias("path")).withColumns({"user_id": F.split("path", "/")[0], "lecture": F.split("path", "/")[1]})
    own = t.lectures(spark, sf_dir).select("user_id", F.col("lecture_id").cast("string").alias("lecture"))
    return objects.join(own, ["user_id", "lecture"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with their white space squeezed; those under three characters are refused."""
    q = tx.squeeze(F.concat(F.lit("  "), F.substring("text", 1, F.expr("cast(pmod(item_id, 6) AS int)")), F.lit(" \n ")))
    return t.table(spark, sf_dir, "benchmark").select("item_id", q.alias("query"), (F.length(q) >= 3).alias("accepted"))


def midpoint_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose midpoint lies from 7 s on and, in odd lectures, before 22 s."""
    s = t.segments(spark, sf_dir)
    end = F.coalesce(F.when(F.col("lecture_id") % 2 == 1, F.lit(22.0)), F.lit(float("inf")))
    middle = (F.col("start_seconds") + F.col("end_seconds")) / 2
    return s.where((middle >= 7) & (middle < end)).groupBy("lecture_id").agg(F.count("*").alias("n"), F.min("sequence").alias("first"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and time of the model, and the passages cited, by outcome."""
    logs = t.chat_logs(spark, sf_dir)
    sources = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.alias("number"), (i <= F.col("k") % 5).alias("cited")))
    out = logs.withColumns({"tokens": d.json_tokens(F.to_json(F.struct("question", "answer"))), "n_cited": F.size(F.filter(sources, lambda s: s["cited"]))})
    return out.groupBy("outcome").agg(F.count("llm_ms").alias("n_calls"), F.sum("llm_ms").alias("llm_ms"), F.sum("tokens").alias("tokens"), F.sum("n_cited").alias("n_cited"), F.count("*").alias("n"))


def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlpit.plans import transcripts as tr

    items = tr._items(spark, sf_dir)
    out = grounding.dropped_counts(items, grounding.ground_items(items, tr._documents(spark, sf_dir)))
    return out.groupBy("kind").agg(F.sum("n_dropped").alias("n_dropped"), F.sum("n_kept").alias("n_kept"))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.readiness(t.table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("busy")), F.lit(True), F.lit(True))


def latest_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.latest_details(t.stage_runs(spark, sf_dir), "CHUNKING").select("job_id", "duration_ms", "started_at")


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, ["correct", "partially_correct", "incorrect", "full", "great"]))
    return t.chat_logs(spark, sf_dir).select(
        F.when(F.col("question_id") % 17 == 0, "old").otherwise("r1").alias("run_id"), (F.col("question_id") + F.when(F.col("question_id") % 13 == 0, 10**9).otherwise(0)).alias("question_id"),
        F.lit("correctness").alias("kind"), F.get(labels, (F.col("question_id") % 5).cast("int")).alias("label"), F.when(F.col("question_id") % 19 > 0, "me").otherwise(" ").alias("annotator"),
    )


def judgment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments appended as JSON lines where nothing speaks against them, read back, and counted beside those refused."""
    checked = checks.judgment_problems(_judgments(spark, sf_dir), t.chat_logs(spark, sf_dir).select("question_id"), "r1")
    path = files.work_dir(spark, "judgments") + "/kept"
    files.append_jsonl(checked.where("problem is null").drop("problem"), path)
    kept = files.read_jsonl(spark, path, "run_id string, question_id long, kind string, label string, annotator string")
    return kept.groupBy(F.lit("stored").alias("result"), "label").agg(F.count("*").alias("n")).union(checked.where("problem is not null").groupBy("problem", F.lit("").alias("label")).agg(F.count("*").alias("n")))


def annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet to fill in, written as CSV and read back."""
    logs = t.chat_logs(spark, sf_dir)
    sources = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct((i * 60.0).cast("double").alias("start_seconds"), (i * 60.0 + 45).cast("double").alias("end_seconds"), F.concat(F.lit('a "b", '), F.col("k").cast("string")).alias("text"), (i <= F.col("k") % 4).alias("cited")))
    results = logs.select(F.lit("r1").alias("run_id"), "question_id", "outcome", "answer", sources.alias("sources"))
    questions = logs.select("question_id", "answerable", "question", F.lit(None).cast("string").alias("reference_answer"))
    path = files.work_dir(spark, "sheet") + "/sheet"
    files.write_sheet(writes.annotation_template(results, questions), path)
    back = files.read_sheet(spark, path, "run_id string, question_id long, answerable boolean, question string, reference_answer string, outcome string, generated_answer string, cited_passages string, correctness_label string, citation_support_label string, annotator string, notes string")
    return back.select("question_id", "answerable", "outcome", F.coalesce("generated_answer", F.lit("")).alias("generated_answer"), F.coalesce("cited_passages", F.lit("")).alias("cited_passages"))


def sheet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = t.chat_logs(spark, sf_dir).select(F.lit("r1").alias("run_id"), "question_id", F.when(F.col("k") % 2 == 0, " correct ").alias("correctness_label"), F.when(F.col("k") % 3 == 0, "full").otherwise(" ").alias("citation_support_label"), F.lit(" me ").alias("annotator"), F.lit(None).cast("string").alias("notes"))
    return writes.label_rows(sheet).groupBy("kind", "label", "annotator").agg(F.count("*").alias("n"))


def dataset_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset document for each user, written as JSON lines and read back."""
    logs = t.chat_logs(spark, sf_dir)
    q = F.struct(F.col("question_id").cast("string").alias("question_id"), "question", "answerable", F.array(F.struct(F.col("search_ms").cast("double").alias("start_seconds"), (F.col("search_ms") + 30).cast("double").alias("end_seconds"))).alias("gold_spans"))
    whole = logs.groupBy(F.concat(F.lit("d"), "user_id").alias("dataset_id")).agg(F.lit("2").alias("version"), F.lit("dev").alias("split"), F.lit(False).alias("frozen"), F.collect_list(q).alias("questions"))
    path = files.work_dir(spark, "dataset") + "/dataset"
    whole.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return files.read_dataset(spark, path, one_a_line=True).select("dataset_id", "version", "question_id", "answerable", F.get("gold_spans", 0)["start_seconds"].alias("start_seconds"))


def conflict_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inserted over those with an even id, their ids taken modulo 300: held ids and repeats are conflicts."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    old = docs.where("doc_id % 2 = 0 and doc_id < 100")
    new = docs.select((F.col("doc_id") % 300).alias("doc_id"), "source", "n_chars")
    table, conflicts = writes.insert_rows(old, new, ["doc_id"])
    return table.select("doc_id", "source", "n_chars", F.lit("held").alias("result")).union(conflicts.select("doc_id", "source", "n_chars", F.lit("conflict")))


def filtered_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_rows(t.lectures(spark, sf_dir), F.col("duration_seconds") > 900).select("lecture_id", "duration_seconds")


def replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language; those of two languages are replaced, twice, by their long ones."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    path = files.work_dir(spark, "parts") + "/parts"
    writes.replace_partitions(docs, path, "lang")
    new = docs.where("lang in ('fr', 'de') and n_chars > 800")
    for _ in range(2):
        writes.replace_partitions(new, path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.lectures(spark, sf_dir).select("lecture_id", "status", F.col("created_at").cast("timestamp_ntz").alias("updated_at"))
    return writes.touched(rows, F.col("status") == "EMBEDDING", F.expr("timestamp_ntz'2025-01-01 00:00:00'")).select("lecture_id", "updated_at")


def account_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 4 == 0, "   ").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("  "), "c_name", F.repeat(F.lit("x"), F.expr("cast(pmod(c_custkey, 130) AS int)")))).when(F.col("c_custkey") % 4 == 2, F.col("c_name"))
    return writes.profiles(t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(name.alias("full_name"))).alias("metadata")))


def deletion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chat_logs(spark, sf_dir).select(F.concat_ws("/", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), F.col("question_id").cast("string")).alias("path"), F.when(~F.col("answerable"), "unreferenced").alias("reason"))
    return writes.deletion_plan(rows).groupBy("owner", "batch").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def note_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as notes, batched by the tokens of their JSON."""
    notes = t.segments(spark, sf_dir).select("lecture_id", "sequence", d.json_tokens(F.to_json(F.struct("raw_text"))).alias("cost"))
    return writes.greedy_groups(notes, "lecture_id", "sequence", "cost", 400)


def evaluation_lectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 15).select(F.col("id").alias("lecture_id"))
    return checks.evaluation_lectures(wanted, t.lectures(spark, sf_dir), t.chunks(spark, sf_dir).where("chunk_id % 7 <> 6 or lecture_id > 4"), F.concat(F.lit("src"), (F.col("lecture_id") % 20 % 9).cast("string")), "mini-a")


def rerun_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of chunk rankings, and another in which some chunks change places or similarities."""
    c = t.chunks(spark, sf_dir).select((F.col("chunk_id") % 40).alias("question_id"), F.floor(F.col("chunk_id") / 40).cast("long").alias("rank"), "chunk_id", F.lit(0.5).alias("similarity"))
    again = c.withColumns({"chunk_id": F.when(F.col("question_id") % 10 == 3, F.col("chunk_id") + F.col("rank") % 2).otherwise(F.col("chunk_id")), "similarity": F.col("similarity") + F.when(F.col("question_id") % 10 == 4, F.lit(1e-6)).otherwise(F.lit(1e-12))}).where("not (question_id = 5 and rank = 0)")
    return checks.rerun_mismatches(c, again)


def tidy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("uh, so I- I "), "raw_text", F.lit(" ,, um."))
    return t.segments(spark, sf_dir).select("lecture_id", "sequence", d.tidy(said).alias("text"))


def summary_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.paragraphs(F.col("raw_text"))
    return t.segments(spark, sf_dir).select("lecture_id", "sequence", F.size(p).cast("long").alias("n_paragraphs"), F.array_join(p, "\n\n").alias("text"))



ORACLE_SQL = {
    "display_formats": """with e as (select *, floor(value * 97) as s, cast(floor(pow(value, 2) * 90001) as bigint) as b, case when event_id % 7 > 0 then cast(floor(value * 20) as bigint) end as m from events)
      select event_id, case when s / 3600 >= 10 then cast(floor(s / 3600 + 0.5) as bigint) || ' h' when s / 3600 >= 1 then printf('%.1f', round(s / 3600, 1)) || ' h' else cast(floor(s / 60 + 0.5) as bigint) || ' min' end as hours,
      case when b >= 1073741824 then printf('%.1f', round(b / 1073741824, 1)) || ' GB' when b >= 1048576 then printf('%.1f', round(b / 1048576, 1)) || ' MB' else greatest(1, cast(floor(b / 1024 + 0.5) as bigint)) || ' KB' end as size,
      case when m < 1000 then m || ' ms' when m is not null then printf('%.1f', round(m / 1000, 1)) || ' s' end as ms,
      '/lectures/' || user_id || case when event_id % 3 > 0 or event_id % 5 = 0 then '?' else '' end || concat_ws('&', case when event_id % 3 > 0 then 't=' || cast(floor(value) as bigint) end, case when event_id % 5 = 0 then 'question=' || event_id end) as link from e""",
    "client_limits": """select event_id, case event_id % 4 when 1 then least(greatest(user_id::double, 1), 90) else 10.0 end as retry_after, least(greatest(coalesce(case when event_id % 9 > 0 then user_id - 20 end, 1), 1), 50) as k,
      cast(greatest(1, ceil(user_id / 12)) as bigint) as n_pages, case when s <= 0 then 48 when least(48, floor(50331648 * 8 * 0.97 / s / 1000)) >= 24 then cast(least(48, floor(50331648 * 8 * 0.97 / s / 1000)) as integer) end as kbps
      from (select *, floor(value * 100)::double - 100 as s from events)""",
    "video_sources": """with v as (select doc_id, case when doc_id % 7 < 4 then right('a_-a_-a_-a_'[1:11 - length(doc_id::varchar)] || doc_id, 11) end as video from documents)
      select doc_id, video, 'youtube:' || video as fingerprint, 'https://www.youtube.com/watch?v=' || video as canonical from v""",
    "status_details": f"""{with_sql("lectures", "jobs")}, x as (select l.status, case when j.job_id % 5 = 0 then 'waiting' else j.status end as job_status, case when j.job_id % 2 = 0 then 'timeout' end as error from lectures l left join jobs j on j.job_id = l.lecture_id),
      y as (select *, case status when 'READY' then 'ready' when 'FAILED' then 'failed' else 'processing' end as grouping, case when status = 'READY' then 'success' when status = 'FAILED' then 'error' when job_status = 'waiting' then 'neutral' when job_status = 'queued' and error is not null then 'warning' else 'info' end as tone,
      case when status in ('READY', 'FAILED') then '' when job_status = 'waiting' then 'Waiting' when job_status = 'queued' and error is not null then 'Retrying' else '' end as badge, case when status = 'EMBEDDING' then 6 end as stage from x)
      select status, job_status, "grouping", tone, badge, cast(stage as bigint) as stage, count(*) as n from y group by all""",
    "covers": f"""{with_sql("lectures")}, h as (select lecture_id, list_reduce(list_prepend(cast(0 as hugeint), list_transform(list_filter(string_split(title, ''), lambda c: c <> ''), lambda c: cast(case when unicode(c) > 65535 then 55296 + ((unicode(c) - 65536) >> 10) else unicode(c) end as hugeint))), lambda a, b: (a * 31 + b) % 4294967296) as h,
      list_filter(string_split(trim(regexp_replace(substr(title, 1, 40), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') as w from lectures)
      select lecture_id, cast(([222, 200, 262, 168, 18, 340, 140, 290])[cast(h % 8 as integer) + 1] as bigint) as hue, upper(case len(w) when 0 then '' when 1 then substr(w[1], 1, 2) else substr(w[1], 1, 1) || substr(w[2], 1, 1) end) as initials from h""",
    "value_checks": """with x as (select *, case when doc_id % 3 > 0 then 'ab' || doc_id || '.mp3' end as name from documents)
      select doc_id, doc_id % 3 > 0 as is_sha256, true as is_video, length('req-' || doc_id) between 8 and 64 as is_request, name, source || '/' || doc_id || '/original/' || coalesce(name, 'file') as path,
      try_cast(case when doc_id % 12 between 1 and 9 then '2024-0' || (doc_id % 12) || '-03' end as timestamp) as day from x""",
    "highlights": """with x as (select item_id, text, len(string_split(lower(text), 'ion')) - 1 as n, len(list_filter(string_split(lower(text), 'ion'), lambda p: p <> '')) as b from benchmark)
      select item_id, cast(n as bigint) as n_matches, cast(n + b as bigint) as n_parts, true as whole from x""",
    "restrictions": """select (['source_private','source_restricted','source_restricted','source_blocked','source_restricted','source_private','source_restricted','source_not_found','source_restricted'])[event_id % 9 + 1] as code, count(*) as n from events group by 1""",
    "media_choice": f"""{with_sql("lectures")} select lecture_id, case when lecture_id % 4 = 0 and lecture_id % 5 = 0 then 'media_unavailable' when lecture_id % 4 > 0 and source_type = 'video' and (lecture_id % 2 = 1 or lecture_id % 6 > 0) then 'video' else 'audio' end as shown from lectures""",
    "media_limits": """with m as (select event_id as id, event_id % 11 > 0 as has_audio, cast(floor(value * 200 - 500) as bigint) as s, cast(floor(value * 9e6) as bigint) as b, case when event_id % 2 = 0 then 2147483648 else 524288000 end as most from events),
      p as (select id, case when b > most then 'file_too_large' when not has_audio then 'no_audio_stream' when s <= 0 then 'media_unreadable' when s > 14400 then 'media_too_long' end as problem from m) select * from p where problem is not null""",
    "object_owners": f"""{with_sql("chat_logs", "lectures")}, o as (select 'src' || (question_id % 20) as user_id, lecture_id, 'src' || (question_id % 20) || '/' || lecture_id || '/' || question_id as path from chat_logs)
      select o.user_id, count(*) as n, min(path) as first from o join lectures l on l.lecture_id = o.lecture_id and l.user_id = o.user_id group by 1""",
    "query_words": r"""with q as (select item_id, trim(regexp_replace('  ' || substr(text, 1, item_id % 6) || chr(32) || chr(10) || ' ', '\s+', ' ', 'g')) as query from benchmark) select item_id, query, length(query) >= 3 as accepted from q""",
    "midpoint_range": f"{with_sql('segments')} select lecture_id, count(*) as n, min(sequence) as first from segments where (start_seconds + end_seconds) / 2 >= 7 and (lecture_id % 2 = 0 or (start_seconds + end_seconds) / 2 < 22) group by 1",
    "usage_totals": f"""{with_sql('chat_logs')} select outcome, count(llm_ms) as n_calls, cast(sum(llm_ms) as bigint) as llm_ms,
      cast(sum(greatest(1, (13 + length(to_json(question)) + coalesce(10 + length(to_json(answer)), 0)) // 3)) as bigint) as tokens, cast(sum(least(4, k % 5)) as bigint) as n_cited, count(*) as n from chat_logs group by 1""",
    "readiness": "select count(*) as n_workers, count(*) filter (where s_acctbal > 0) as n_busy, case when count(*) > 0 then 'ok' else 'degraded' end as status from supplier",
    "latest_chunking": f"""{with_sql("stage_runs")}, n as (select *, row_number() over (partition by job_id order by started_at + to_milliseconds(duration_ms) desc nulls last, started_at desc, tie desc, tie2 desc) as nth from stage_runs where stage = 'CHUNKING' and status = 'succeeded')
      select job_id, duration_ms, started_at from n where nth = 1""",
    "judgment_report": """with j as (select event_id, (['correct', 'partially_correct', 'incorrect', 'full', 'great'])[event_id % 5 + 1] as label from events),
      p as (select *, case when event_id % 17 = 0 then 'other_run' when event_id % 13 = 0 then 'unknown_question' when event_id % 5 > 2 then 'unknown_label' when event_id % 19 = 0 then 'no_annotator' end as problem from j)
      select coalesce(problem, 'stored') as result, case when problem is null then label else '' end as label, count(*) as n from p group by all""",
    "annotation_sheet": f"""{with_sql("chat_logs")} select question_id, answerable, outcome, coalesce(answer, '') as generated_answer,
      list_aggregate(list_transform(range(1, 1 + least(3, k % 4)), lambda i: '[' || (i * 60) || '-' || (i * 60 + 45) || 's] a "b", ' || k), 'string_agg', ' || ') as cp, coalesce(cp, '') as cited_passages from chat_logs""",
    "sheet_labels": """with k as (select cast(props->>'$.k' as integer) as k from events), l as (select 'correctness' as kind, 'correct' as label from k where k % 2 = 0 union all select 'citation_support', 'full' from k where k % 3 = 0)
      select kind, label, 'me' as annotator, count(*) as n from l group by all""",
    "dataset_questions": f"{with_sql('chat_logs')} select 'd' || user_id as dataset_id, '2' as version, cast(question_id as varchar) as question_id, answerable, cast(search_ms as double) as start_seconds from chat_logs",
    "conflict_insert": """with o as (select doc_id, source, n_chars from documents where doc_id % 2 = 0 and doc_id < 100), n as (select doc_id % 300 as doc_id, source, n_chars, row_number() over (partition by doc_id % 300 order by source, n_chars) as nth from documents),
      m as (select n.*, exists (select 1 from o where o.doc_id = n.doc_id) as held from n)
      select doc_id, source, n_chars, 'held' as result from o union all select doc_id, source, n_chars, case when nth = 1 and not held then 'held' else 'conflict' end from m""",
    "filtered_delete": f"{with_sql('lectures')} select lecture_id, duration_seconds from lectures where not coalesce(duration_seconds > 900, false)",
    "replace_partitions": "select lang, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents where lang not in ('fr', 'de') or n_chars > 800 group by lang",
    "touched_rows": f"{with_sql('lectures')} select lecture_id, case when status = 'EMBEDDING' then timestamp '2025-01-01' else created_at end as updated_at from lectures",
    "account_profiles": "select c_custkey as id, case c_custkey % 4 when 1 then substr(c_name || repeat('x', cast(c_custkey % 130 as integer)), 1, 120) when 2 then c_name end as display_name from customer",
    "deletion_plan": """with p as (select 'u' || (user_id % 3) as owner, 'u' || (user_id % 3) || '/' || event_id as path from events where user_id % 3 = 0), b as (select *, (row_number() over (partition by owner order by path) - 1) // 100 as batch from p)
      select owner, batch, count(*) as n, min(path) as first, max(path) as last from b group by all""",
    "evaluation_lectures": f"""{with_sql("lectures", "chunks")}, c as (select lecture_id, count(*) filter (where embedding_model <> 'mini-a') as bad from chunks where chunk_id % 7 <> 6 or lecture_id > 4 group by 1), w as (select range as lecture_id from range(15))
      select w.lecture_id, case when l.status is null then 'missing' when l.user_id <> 'src' || (w.lecture_id % 20 % 9) then 'other_owner' when l.status <> 'READY' then 'not_ready' when bad is null or bad > 0 then 'other_model' end as problem from w left join lectures l using (lecture_id) left join c using (lecture_id)""",
    "rerun_check": """with c as (select vec_id % 40 as question_id, vec_id // 40 as rank from embeddings), x as (select *, case when question_id % 10 = 3 then rank % 2 = 1 when question_id % 10 = 4 then true when question_id = 5 then rank = 0 else false end as differs from c)
      select question_id, count(*) as n_differ from x where differs group by 1""",
}
ORACLE_SQL["annotation_sheet"] = f"with x as ({ORACLE_SQL['annotation_sheet']}) select question_id, answerable, outcome, generated_answer, cited_passages from x"
QUERIES = {
    f.__name__: f
    for f in (
        display_formats, client_limits, video_sources, status_details, covers, value_checks, highlights, restrictions, media_choice, media_limits, object_owners, query_words, midpoint_range, usage_totals, dropped_items, readiness,
        latest_chunking, judgment_report, annotation_sheet, sheet_labels, dataset_questions, conflict_insert, filtered_delete, replace_partitions, touched_rows, account_profiles, deletion_plan, note_batches, evaluation_lectures,
        rerun_check, tidy_texts, summary_paragraphs,
    )
}
