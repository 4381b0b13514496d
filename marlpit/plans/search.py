"""Vector search, evidence, prompts and answers. The queries are all embeddings whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.operators import retrieval
from marlpit.operators.vector_index import VectorIndex
from marlpit.schema import CONTEXT_TOKENS, RAG_TOP_K, SEARCH_CANDIDATES, SEARCH_LIMIT, SEARCH_PER_LECTURE
from marlpit.sources import files
from marlpit.sources import tables as t
from marlpit.sources.tables import with_sql

#: The supplied vectors are far apart: the reference's 0.6 would leave each query only itself.
THRESHOLD = 0.2


def _queries(chunks: DataFrame) -> DataFrame:
    return chunks.where("pmod(chunk_id, 50) = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))


def _search(threshold: float):
    def search(spark: SparkSession, sf_dir: str) -> DataFrame:
        chunks = t.chunks(spark, sf_dir)
        out = retrieval.search_content(_queries(chunks), chunks, t.lectures(spark, sf_dir), SEARCH_CANDIDATES, threshold, SEARCH_PER_LECTURE, SEARCH_LIMIT)
        return out.select("query_id", "place", "chunk_id", "lecture_id", retrieval.shown())

    return search


def vector_topk_lecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's best chunks in its own lecture."""
    chunks = t.chunks(spark, sf_dir)
    q = chunks.where("pmod(chunk_id, 50) = 0").select(F.col("chunk_id").alias("query_id"), F.col("lecture_id").alias("query_lecture"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))
    return retrieval.similarities(q, chunks, RAG_TOP_K, own_lecture=True).select("query_id", F.col("rank").alias("place"), "chunk_id", retrieval.shown())


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = t.chunks(spark, sf_dir)
    near = retrieval.similarities(_queries(chunks), chunks, RAG_TOP_K).join(t.chunk_texts(spark, sf_dir), "chunk_id")
    return retrieval.evidence(near.withColumn("token_estimate", tx.estimate_tokens(F.col("text"))), THRESHOLD, CONTEXT_TOKENS)


def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("query_id", "number", "chunk_id", retrieval.shown(), "token_estimate")


def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every query, hashed: numbered passages with their clocks, markup neutralised."""
    e = _evidence(spark, sf_dir)
    line = F.format_string("[%d] (%s-%s) %s", F.col("number"), tx.clock(F.col("start_seconds")), tx.clock(F.col("end_seconds")), tx.neutralise(F.col("text")))
    whole = e.select("query_id", F.struct("number", line.alias("line")).alias("p")).groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    prompt = F.array_join(F.transform("ps", lambda p: p["line"]), "\n\n")
    return whole.select("query_id", F.size("ps").cast("long").alias("n_passages"), F.length(prompt).cast("long").alias("n_chars"), F.sha2(prompt, 256).alias("prompt_sha256"))


def interpret_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers rebuilt from events, every fifth blank: citations are valid if they name one of three passages."""
    raw = F.struct(
        F.when(F.col("answerable"), F.lit("true")).otherwise("yes").alias("answerable"),
        F.array(F.col("k").cast("string"), (F.col("k") % 5).cast("string"), F.lit("x")).alias("citations"),
        F.when(F.col("question_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" About   "), "question")).alias("answer"),
    )
    logs = t.chat_logs(spark, sf_dir).select("question_id", F.to_json(raw).alias("raw"))
    # Models wrap their JSON in a fence now and then.
    bare = F.regexp_replace(F.when(F.col("question_id") % 2 == 0, F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))).otherwise(F.col("raw")), r"^```[a-z]*\s*|\s*```$", "")
    m = logs.select("question_id", F.from_json(bare, "answerable string, citations array<string>, answer string").alias("m")).select("question_id", "m.*")
    out = retrieval.interpret(m, F.lit(3))
    return out.select("question_id", "outcome", "decision", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.coalesce("shown_answer", F.lit("")).alias("answer"))


def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last chunk of every lecture, and the chunk of it each finds first."""
    chunks = t.chunks(spark, sf_dir)
    p = retrieval.probes(chunks).select(F.col("chunk_id").alias("query_id"), F.col("lecture_id").alias("query_lecture"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))
    return retrieval.similarities(p, chunks, 1, own_lecture=True).select("query_id", "chunk_id", retrieval.shown(), (F.col("query_id") == F.col("chunk_id")).alias("found_itself"))


def index_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.index_report(t.chunks(spark, sf_dir), "mini-a")


def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest READY chunks of every query through a kept index, at the fewest probes with a recall of 0.9."""
    chunks = t.chunks(spark, sf_dir)
    index = VectorIndex.build(chunks, files.work_dir(spark, "index"))
    probes, recall = index.calibrate(_queries(chunks), chunks, 10)
    ready = t.lectures(spark, sf_dir).where("status = 'READY'")
    out = index.search(_queries(chunks), 10, probes, ready)
    return out.select("query_id", "rank", "chunk_id", retrieval.shown(), F.lit(probes).alias("probes"), F.lit(index.lists).alias("lists"), F.lit(recall).alias("measured_recall"))


def vector_index_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every list probed, which is the exact search."""
    chunks = t.chunks(spark, sf_dir)
    index = VectorIndex.build(chunks, files.work_dir(spark, "index"))
    out = index.search(_queries(chunks), 10, index.lists, t.lectures(spark, sf_dir).where("status = 'READY'"))
    return out.select("query_id", "rank", "chunk_id", retrieval.shown())


def segment_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event, the chunk of its lecture playing at its time: the last that started. Union and a running last, no range join."""
    key = F.expr("cast(pmod(user_id, 10) AS long)")
    at = F.expr("cast(floor(latency_ms * 20) AS double)")
    events = t.chat_logs(spark, sf_dir).select(key.alias("lecture_id"), at.alias("at"), F.lit(1).alias("kind"), "question_id", F.lit(None).cast("long").alias("chunk_id"))
    starts = t.chunks(spark, sf_dir).select("lecture_id", F.col("start_seconds").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("question_id"), "chunk_id")
    # A lecture's timeline is cut into hours; an hour begins with the last chunk started before it, of which there is one for each lecture and hour.
    both = events.unionByName(starts).withColumn("hour", F.floor(F.col("at") / 3600).cast("long"))
    by_hour = both.groupBy("lecture_id", "hour").agg(F.max_by("chunk_id", F.when(F.col("kind") == 0, F.col("at"))).alias("last_in"))
    carried = by_hour.select("lecture_id", "hour", F.last("last_in", ignorenulls=True).over(Window.partitionBy("lecture_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.last("chunk_id", ignorenulls=True).over(Window.partitionBy("lecture_id", "hour").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("inside", inside).where("kind = 1").join(carried, ["lecture_id", "hour"]).select("question_id", "lecture_id", F.coalesce("inside", "carried", F.lit(-1)).alias("chunk_id"))


def segment_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that contain a text of two characters or more, case aside, with their place."""
    s = t.segments(spark, sf_dir).where(F.trim("raw_text") != "")
    placed = s.withColumn("place", F.row_number().over(Window.partitionBy("lecture_id").orderBy("sequence")) - 1).withColumn("place", F.col("place").cast("long"))
    return placed.where(F.lower("raw_text").contains("tion")).select("lecture_id", "sequence", "place")


_SIM = f"""{with_sql("chunks", "lectures")}, q as (select chunk_id as query_id, lecture_id as query_lecture, embedding_model as query_model, embedding as query from chunks where chunk_id % 50 = 0),
s as (select query_id, query_lecture, c.*, list_dot_product(c.embedding, query) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(query, query))) as similarity
  from q join chunks c on c.embedding_model = q.query_model)"""
_RANK = "row_number() over (partition by query_id order by similarity desc, sequence)"
_EVIDENCE = rf"""{_SIM}, r as (select *, {_RANK} as rank from s), x as (select r.*, text, cast(greatest(1, ceil(len(regexp_extract_all(text, '\S+')) * 1.3::double)) as integer) as token_estimate
  from r join documents on chunk_id = doc_id where rank <= {RAG_TOP_K} and similarity >= {THRESHOLD}),
y as (select *, sum(token_estimate) over (partition by query_id order by similarity desc, sequence rows unbounded preceding) as used, {_RANK} as nth from x),
e as (select *, row_number() over (partition by query_id order by sequence) as number from y where used <= {CONTEXT_TOKENS} or nth = 1)"""


def _search_sql(threshold: float) -> str:
    return f"""{_SIM}, r as (select s.*, {_RANK} as rank from s join lectures l on l.lecture_id = s.lecture_id and l.status = 'READY'),
    c as (select *, row_number() over (partition by query_id, lecture_id order by similarity desc, sequence) as k from r where rank <= {SEARCH_CANDIDATES} and similarity >= {threshold}),
    p as (select *, {_RANK} as place from c where k <= {SEARCH_PER_LECTURE}) select query_id, place, chunk_id, lecture_id, round(similarity, 4) as similarity from p where place <= {SEARCH_LIMIT}"""


def _clock_sql(c: str) -> str:
    s = f"cast(floor({c}) as bigint)"
    return f"case when {s} >= 3600 then format('{{}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} % 3600 // 60, {s} % 60) else format('{{:02d}}:{{:02d}}', {s} // 60, {s} % 60) end"


ORACLE_SQL = {
    "search_content": _search_sql(THRESHOLD),
    "search_content_strict": _search_sql(0.6),
    "vector_topk_lecture": f"{_SIM}, p as (select *, {_RANK} as place from s where lecture_id = query_lecture) select query_id, place, chunk_id, round(similarity, 4) as similarity from p where place <= {RAG_TOP_K}",
    "vector_index_all_lists": f"{_SIM}, r as (select s.*, {_RANK} as rank from s join lectures l on l.lecture_id = s.lecture_id and l.status = 'READY') select query_id, rank, chunk_id, round(similarity, 4) as similarity from r where rank <= 10",
    "evidence_budget": f"{_EVIDENCE} select query_id, number, chunk_id, round(similarity, 4) as similarity, token_estimate from e",
    "evidence_prompt": f"""{_EVIDENCE}, t as (select query_id, number, '[' || number || '] (' || {_clock_sql("start_seconds")} || '-' || {_clock_sql("end_seconds")} || ') ' || translate(text, '<>', '‹›') as line from e),
      g as (select query_id, count(*) as n_passages, string_agg(line, chr(10) || chr(10) order by number) as prompt from t group by query_id) select query_id, n_passages, length(prompt) as n_chars, sha256(prompt) as prompt_sha256 from g""",
    "interpret_answers": f"""{with_sql("chat_logs")}, c as (select question_id, answerable, list_sort(list_distinct(list_filter([k, k % 5], lambda x: x between 1 and 3))) as cited,
      case when question_id % 5 = 0 then '' else 'About ' || question end as a from chat_logs),
      d as (select *, case when a = '' or not answerable then 'model_declined' when len(cited) = 0 then 'no_valid_citations' else 'answered' end as decision from c)
      select question_id, case when decision = 'answered' then 'answered' else 'insufficient_evidence' end as outcome, decision, case when decision = 'answered' then array_to_string(cited, ',') else '' end as cited,
      case when decision = 'answered' then a else '' end as answer from d""",
    "self_retrieval": f"""{with_sql("chunks")}, n as (select *, row_number() over (partition by lecture_id order by sequence) - 1 as nth, count(*) over (partition by lecture_id) as n from chunks),
      q as (select chunk_id as query_id, lecture_id as query_lecture, embedding_model as query_model, embedding as query from n where nth = 0 or nth = n // 2 or nth = n - 1),
      s as (select query_id, c.chunk_id, sequence, list_dot_product(c.embedding, query) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(query, query))) as similarity from q join chunks c on c.embedding_model = q.query_model and c.lecture_id = q.query_lecture),
      r as (select *, {_RANK} as rank from s) select query_id, chunk_id, round(similarity, 4) as similarity, query_id = chunk_id as found_itself from r where rank = 1""",
    "index_completeness": f"{with_sql('chunks')} select lecture_id, count(*) as n_chunks, count(*) filter (where embedding is null) as n_missing, count(*) filter (where embedding_model <> 'mini-a') as n_other_model from chunks group by lecture_id",
    "segment_asof": f"""{with_sql("chunks", "chat_logs")}, e as (select question_id, cast(user_id % 10 as bigint) as lecture_id, cast(floor(latency_ms * 20) as double) as at from chat_logs)
      select question_id, e.lecture_id, coalesce((select max(chunk_id) from chunks c where c.lecture_id = e.lecture_id and c.start_seconds <= e.at), -1) as chunk_id from e""",
    "segment_find": f"""{with_sql("segments")}, p as (select *, row_number() over (partition by lecture_id order by sequence) - 1 as place from segments where trim(raw_text) <> '')
      select lecture_id, sequence, place from p where contains(lower(raw_text), 'tion')""",
}
QUERIES = {"search_content": _search(THRESHOLD), "search_content_strict": _search(0.6)} | {
    f.__name__: f for f in (vector_topk_lecture, vector_index_search, vector_index_all_lists, evidence_budget, evidence_prompt, interpret_answers, self_retrieval, index_completeness, segment_asof, segment_find)
}
