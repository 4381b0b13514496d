"""Evaluation queries: retrieval, abstention, citations, agreement, latency, error rates, samples, run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.operators import metrics, retrieval, wer
from marlpit.plans import search
from marlpit.schema import RAG_TOP_K
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql

CUT, CUTS, TOLERANCE = 3, [1, 3, 5], 30.0


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = t.chunks(spark, sf_dir)
    return retrieval.similarities(search._queries(chunks), chunks, RAG_TOP_K).select(F.col("query_id").alias("question_id"), "rank", "chunk_id", "start_seconds", "end_seconds", "similarity")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gold spans a question: its own chunk, and one twenty chunks on."""
    q = search._queries(t.chunks(spark, sf_dir)).select(F.col("query_id").alias("question_id"), F.explode(F.array(F.lit(0), F.lit(20))).alias("span_no"))
    return q.select("question_id", "span_no", ((F.col("question_id") + F.col("span_no")) * 60.0 + 10.0).alias("gold_start"), ((F.col("question_id") + F.col("span_no")) * 60.0 + 40.0).alias("gold_end"))


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval_scores(_ranked(spark, sf_dir), _spans(spark, sf_dir), CUT, TOLERANCE)


def retrieval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means for three tolerances in one plan."""
    every = None
    ranked, spans = _ranked(spark, sf_dir), _spans(spark, sf_dir)
    for tolerance in (0.0, 30.0, 3000.0):
        s = metrics.retrieval_scores(ranked, spans, CUT, tolerance)
        s = s.agg(F.lit(tolerance).alias("tolerance"), F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "reciprocal_rank", "timestamp_hit")])
        every = s if every is None else every.union(s)
    return every


def retrieval_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means for every cut."""
    s = metrics.retrieval_by_cut(_ranked(spark, sf_dir), _spans(spark, sf_dir), CUTS, TOLERANCE)
    return s.groupBy("cut").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "reciprocal_rank", "timestamp_hit")])


def evidence_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the evidence of a question meets a gold span."""
    used = search._evidence(spark, sf_dir).select(F.col("query_id").alias("question_id"), "start_seconds", "end_seconds")
    return metrics.evidence_hits(used, _spans(spark, sf_dir), TOLERANCE)


def abstention_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.abstention(t.chat_logs(spark, sf_dir))


def abstention_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.abstention(t.chat_logs(spark, sf_dir), "user_id")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chat_logs(spark, sf_dir).where("outcome = 'answered'").select("question_id", F.when(F.col("k") % 4 == 0, 0).otherwise(1).alias("n_cited"))


def citation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "full").when(F.col("toxic") == 1, "none").otherwise("partial")
    labels = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), label.alias("label"))
    return metrics.citation_support(_answered(spark, sf_dir), labels)


def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each judge and question; labels are appended in order of doc_id, questions are its sevenths."""
    l = t.table(spark, sf_dir, "labels")
    rows = l.select(F.when(F.col("doc_id") % 2 == 0, "human").otherwise("llm").alias("judge_type"), F.expr("doc_id div 7").alias("question_id"), F.col("doc_id").alias("appended"), F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("label"))
    return metrics.last_labels(rows)


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t.table(spark, sf_dir, "labels")
    return metrics.cohen_kappa(l.select(F.col("doc_id").alias("item"), F.col("quality").cast("string").alias("rater_a"), F.when(F.col("doc_id") % 5 > 0, (1 - F.col("toxic")).cast("string")).alias("rater_b")))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chat_logs(spark, sf_dir).groupBy("outcome").agg(*metrics.latency("llm_ms"))


def question_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_by_metric(t.chat_logs(spark, sf_dir), ["llm_ms", "search_ms", "latency_ms"])


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stage_runs(spark, sf_dir).where("status = 'succeeded'").groupBy("stage").agg(*metrics.latency("duration_ms"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the same turn without every seventh word and with its first word changed."""
    s = t.segments(spark, sf_dir)
    words = F.split("raw_text", r"\s+")
    heard = F.transform(F.filter(words, lambda w, i: i % 7 != 6), lambda w, i: F.when(i == 0, F.lit("well")).otherwise(w))
    return s.select((F.col("lecture_id") * 1000 + F.col("sequence")).alias("id"), F.col("raw_text").alias("reference"), F.array_join(heard, " ").alias("hypothesis"))


def wer_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wer.error_counts(_pairs(spark, sf_dir))


def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wer.corpus_rates(wer.error_counts(_pairs(spark, sf_dir)))


def edit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return wer.edit_breakdown(p.select("id", wer.spoken(F.col("reference")).alias("r"), wer.spoken(F.col("hypothesis")).alias("h")))


def asr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcription runs rebuilt from documents: a tenth failed."""
    d = t.table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 10 == 0, "failed").otherwise("ok").alias("status"), (F.col("n_chars") / 10.0).alias("audio"), (F.col("n_chars") / 37.0).alias("asr"))
    ok = F.col("status") == "ok"
    audio, asr = F.sum(F.when(ok, F.col("audio"))), F.sum(F.when(ok, F.col("asr")))
    return d.agg(
        F.count_if(ok).alias("n_scored"), F.count_if(~ok).alias("n_failed"), F.round(audio, 3).alias("audio_seconds"), F.round(asr, 3).alias("asr_seconds"), F.round(F.try_divide(asr, audio), 4).alias("real_time_factor"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages")
    )


def midpoint_sample(spark: SparkSession, sf_dir: str, limit: int = 25) -> DataFrame:
    """Of the n documents of each source in order of id, those at floor((i + 0.5) * n / limit); all where there are no more."""
    d = t.table(spark, sf_dir, "documents").select("source", "doc_id")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    place = d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    wanted = sizes.select("source", F.explode(F.when(F.col("n") <= limit, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor((i + 0.5) * F.col("n") / limit).cast("long")))).alias("place"))
    return place.join(wanted, ["source", "place"]).select("source", "doc_id")


def _run(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    s = t.segments(spark, sf_dir).withColumn("id", F.col("lecture_id") * 1000 + F.col("sequence"))
    if not second:
        return s.where("pmod(id, 13) <> 0").select("id", F.lit("ok").alias("status"), F.col("raw_text").alias("hypothesis"))
    return s.where("pmod(id, 17) <> 0").select("id", F.when(F.col("id") % 5 == 0, "failed").otherwise("ok").alias("status"), F.when(F.col("id") % 3 == 0, F.upper("raw_text")).otherwise(F.col("raw_text")).alias("hypothesis"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wer.run_differences(_run(spark, sf_dir, False), _run(spark, sf_dir, True))


def id_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents or labels without the other."""
    d, l = t.table(spark, sf_dir, "documents").select("doc_id"), t.table(spark, sf_dir, "labels").select("doc_id")
    return d.exceptAll(l).unionByName(l.exceptAll(d))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with evidence at each of five thresholds, in one plan: the settings are rows."""
    settings = spark.createDataFrame([(x / 10,) for x in range(1, 6)], "threshold double")
    best = _ranked(spark, sf_dir).where("chunk_id <> question_id").groupBy("question_id").agg(F.max("similarity").alias("best"))
    return best.crossJoin(F.broadcast(settings)).groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("best") >= F.col("threshold")).alias("n_with_evidence"))


def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of an evaluation dataset over benchmark items: unique ids, texts present, ends with a sentence."""
    b = t.table(spark, sf_dir, "benchmark")
    return b.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("item_id")).alias("n_repeated_ids"), F.count_if(F.coalesce(F.trim("text") == "", F.lit(True))).alias("n_empty"), F.count_if(F.col("text").rlike(r"[.!?]$")).alias("n_closed"))


_SCORES = f"""{search._SIM}, r as (select query_id as question_id, chunk_id, start_seconds, end_seconds, similarity, row_number() over (partition by query_id order by similarity desc, sequence) as rank from s),
k as (select * from r where rank <= {RAG_TOP_K}), g as (select query_id as question_id, n as span_no, (query_id + n) * 60.0::double + 10 as gs, (query_id + n) * 60.0::double + 40 as ge from q, (values (0), (20)) v(n)),
tol as (select * from (values (0.0::double), (30.0), (3000.0)) t(t)),
m as (select t, g.question_id, span_no, rank, greatest(start_seconds, gs - t) < least(end_seconds, ge + t) as rel, start_seconds between gs - t and ge + t as ins from tol, g left join k using (question_id)),
b as (select t, question_id, span_no, max(case when rel and rank <= {CUT} then 1 else 0 end) as cov, min(case when rel then rank end) as fr, max(case when ins and rank <= {CUT} then 1 else 0 end) as ts from m group by all),
sc as (select t, question_id, max(cov) as hit, round(sum(cov)::double / count(*), 6) as recall, round(coalesce(1.0::double / min(fr), 0), 6) as reciprocal_rank, max(ts) as timestamp_hit from b group by all)"""
_LATENCY = "count({v}) as n, count(*) filter (where {v} is null) as n_missing, round(avg({v}), 6) as mean, median({v}) as median, quantile_disc({v}, 0.9) as p90, quantile_disc({v}, 0.95) as p95, min({v}) as least, max({v}) as most"
_ABSTAIN = """count(*) as n, count(*) filter (where answerable) as n_answerable, count(*) filter (where not answerable) as n_unanswerable, count(*) filter (where refused) as n_refused,
  round(count(*) filter (where refused and not answerable)::double / nullif(count(*) filter (where refused), 0), 6) as precision, round(count(*) filter (where refused and not answerable)::double / nullif(count(*) filter (where not answerable), 0), 6) as recall,
  round(count(*) filter (where refused and answerable)::double / nullif(count(*) filter (where answerable), 0), 6) as false_refusal, round(count(*) filter (where not refused and not answerable)::double / nullif(count(*) filter (where not answerable), 0), 6) as answered_unanswerable"""
_RUNS = """with s as (select conv_id * 1000 + turn as id, text from conversations), a as (select id, 'ok' as st, text as h from s where id % 13 <> 0),
b as (select id, case when id % 5 = 0 then 'failed' else 'ok' end as st, case when id % 3 = 0 then upper(text) else text end as h from s where id % 17 <> 0)"""
ORACLE_SQL = {
    "retrieval_scores": f"{_SCORES} select question_id, hit, recall, reciprocal_rank, timestamp_hit from sc where t = 30",
    "retrieval_means": f"{_SCORES} select t as tolerance, count(*) as n, round(avg(hit), 6) as hit, round(avg(recall), 6) as recall, round(avg(reciprocal_rank), 6) as reciprocal_rank, round(avg(timestamp_hit), 6) as timestamp_hit from sc group by t",
    "retrieval_cuts": f"""{_SCORES}, fr as (select question_id, span_no, min(case when rel then rank end) as fr, min(case when ins then rank end) as fi from m where t = 30 group by all),
      pc as (select question_id, c as cut, max(case when fr <= c then 1 else 0 end) as hit, round(sum(case when fr <= c then 1 else 0 end)::double / count(*), 6) as recall, round(coalesce(1.0::double / min(fr), 0), 6) as rr, max(case when fi <= c then 1 else 0 end) as ts from fr, (values (1), (3), (5)) v(c) group by all)
      select cut, count(*) as n, round(avg(hit), 6) as hit, round(avg(recall), 6) as recall, round(avg(rr), 6) as reciprocal_rank, round(avg(ts), 6) as timestamp_hit from pc group by cut""",
    "evidence_hit": f"""{search._EVIDENCE}, g as (select query_id, (query_id + n) * 60.0::double + 10 as gs, (query_id + n) * 60.0::double + 40 as ge from q, (values (0), (20)) v(n))
      select g.query_id as question_id, max(case when greatest(start_seconds, gs - 30) < least(end_seconds, ge + 30) then 1 else 0 end) as evidence_hit from g left join e on e.query_id = g.query_id group by 1""",
    "abstention_rates": f"{with_sql('chat_logs')}, x as (select *, outcome = 'insufficient_evidence' as refused from chat_logs) select {_ABSTAIN} from x",
    "abstention_by_user": f"{with_sql('chat_logs')}, x as (select *, outcome = 'insufficient_evidence' as refused from chat_logs) select user_id, {_ABSTAIN} from x group by user_id",
    "citation_support": f"""{with_sql("chat_logs")}, a as (select question_id, case when k % 4 = 0 then 0 else 1 end as c from chat_logs where outcome = 'answered'),
      l as (select doc_id as question_id, case when quality = 1 then 'full' when toxic = 1 then 'none' else 'partial' end as label from labels), b as (select * from a left join l using (question_id))
      select count(*) as n_answered, round(count(*) filter (where c > 0)::double / nullif(count(*), 0), 6) as coverage, count(label) as n_labelled, count(*) filter (where label is null) as n_unlabelled,
      round(count(*) filter (where label = 'full')::double / nullif(count(label), 0), 6) as full_rate, round(count(*) filter (where label = 'partial')::double / nullif(count(label), 0), 6) as partial_rate, round(count(*) filter (where label = 'none')::double / nullif(count(label), 0), 6) as none_rate from b""",
    "correctness": """with r as (select case when doc_id % 2 = 0 then 'human' else 'llm' end as judge_type, doc_id // 7 as question_id, doc_id, case when quality = 1 then 'correct' else 'incorrect' end as label from labels),
      l as (select judge_type, question_id, arg_max(label, doc_id) as label from r group by all) select judge_type, label, count(*) as n from l group by all""",
    "cohen_kappa": """with b as (select cast(quality as varchar) as a, cast(1 - toxic as varchar) as b from labels where doc_id % 5 > 0), n as (select count(*) as n, count(*) filter (where a = b) as same from b),
      ma as (select a as l, count(*) as na from b group by 1), mb as (select b as l, count(*) as nb from b group by 1), c as (select coalesce(sum(na * nb), 0) as common from ma join mb using (l)),
      p as (select n, same::double / nullif(n, 0) as po, common::double / nullif(n::double * n, 0) as pe from n, c) select n, round(po, 6) as agreement, round(case when pe < 1 then (po - pe) / (1 - pe) end, 6) as kappa from p""",
    "latency_summary": f"{with_sql('chat_logs')} select outcome, {_LATENCY.format(v='llm_ms')} from chat_logs group by outcome",
    "question_latency": f"{with_sql('chat_logs')}, u as (select 'llm_ms' as metric, llm_ms as value from chat_logs union all select 'search_ms', search_ms from chat_logs union all select 'latency_ms', latency_ms from chat_logs) select metric, {_LATENCY.format(v='value')} from u group by metric",
    "stage_latency": f"{with_sql('stage_runs')} select stage, {_LATENCY.format(v='duration_ms')} from stage_runs where status = 'succeeded' group by stage",
    "asr_summary": """with d as (select lang, doc_id % 10 <> 0 as ok, n_chars / 10.0::double as audio, n_chars / 37.0::double as asr from documents)
      select count(*) filter (where ok) as n_scored, count(*) filter (where not ok) as n_failed, round(sum(audio) filter (where ok), 3) as audio_seconds, round(sum(asr) filter (where ok), 3) as asr_seconds,
      round(sum(asr) filter (where ok) / sum(audio) filter (where ok), 4) as real_time_factor, string_agg(distinct lang, ',' order by lang) as languages from d""",
    "midpoint_sample": """with d as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as place, count(*) over (partition by source) as n from documents)
      select source, doc_id from d where n <= 25 or place in (select cast(floor((i + 0.5) * d.n / 25) as bigint) from range(25) r(i))""",
    "run_compare": f"""{_RUNS}, j as (select coalesce(a.id, b.id) as id, case when a.id is null then 'only_second' when b.id is null then 'only_first' when a.st is distinct from b.st then 'status' when a.h is distinct from b.h then 'hypothesis' end as difference from a full join b on a.id = b.id)
      select * from j where difference is not null""",
    "id_symmetric_difference": "select doc_id from ((select doc_id from documents except all select doc_id from labels) union all (select doc_id from labels except all select doc_id from documents))",
    "threshold_sweep": f"""{search._SIM}, r as (select query_id, chunk_id, similarity, row_number() over (partition by query_id order by similarity desc, sequence) as rank from s),
      b as (select query_id, max(similarity) as best from r where rank <= {RAG_TOP_K} and chunk_id <> query_id group by 1) select x / 10::double as threshold, count(*) as n, count(*) filter (where best >= x / 10::double) as n_with_evidence from b, range(1, 6) t(x) group by x""",
    "dataset_checks": "select count(*) as n, count(*) - count(distinct item_id) as n_repeated_ids, count(*) filter (where coalesce(trim(text) = '', true)) as n_empty, count(*) filter (where regexp_matches(text, '[.!?]$')) as n_closed from benchmark",
}
QUERIES = {
    f.__name__: f
    for f in (
        retrieval_scores, retrieval_means, retrieval_cuts, evidence_hit, abstention_rates, abstention_by_user, citation_support, correctness, cohen_kappa, latency_summary, question_latency, stage_latency,
        wer_total, corpus_wer, edit_breakdown, asr_summary, midpoint_sample, run_compare, id_symmetric_difference, threshold_sweep, dataset_checks,
    )
}
