"""Callers' views, cascades, retries, experiments, media heads and canonical JSON, on examples of their own."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions import canonical, media
from marlpit.operators import ablation, access


def test_containers(spark):
    cases = [
        (b"\0\0\0\x18ftypmp42" + b"\0" * 8, "video", "mp4", "video/mp4"), (b"\0\0\0\x14ftypqt  ", "audio", "mov", None), (b"\0\0\0\x1cftypM4B ", "audio", "m4a", "audio/mp4"), (b"\0\0\0\x1cftypM4A ", "video", "m4a", None),
        (b"\x1aE\xdf\xa3" + b"\0" * 30 + b"webm", "audio", "webm", "audio/webm"), (b"\x1aE\xdf\xa3" + b"\0" * 70 + b"webm", "video", "mkv", "video/x-matroska"), (b"\x1aE\xdf\xa3", "audio", "mkv", None), (b"\xff\xe3", "audio", "mp3", "audio/mpeg"),
        (b"\xff\x1f\0", "audio", None, None), (b"ID3", "video", "mp3", None), (b"RIFF....WAVEfmt ", "audio", "wav", "audio/wav"), (b"RIFF....AVI LIST", "audio", None, None), (b"RIFF....WAV", "audio", None, None), (b"OggS", "audio", "ogg", "audio/ogg"),
        (b"%PDF-1.4", "video", None, None), (b"", "video", None, None), (None, "video", None, None), (b"\xff", "audio", None, None), (b"\0\0\0\x18ftyp", "video", None, None),
    ]
    frame = spark.createDataFrame([(i, h, k) for i, (h, k, _, _) in enumerate(cases)], "i int, head binary, kind string")
    out = {r.i: (r.c, r.m) for r in frame.select("i", "kind", media.container(F.col("head")).alias("c")).withColumn("m", media.mime_type(F.col("c"), F.col("kind"))).collect()}
    assert out == {i: (c, m) for i, (_, _, c, m) in enumerate(cases)}


def test_probe_records(spark):
    texts = [
        '{"streams":[{"codec_type":"audio","codec_name":"opus","sample_rate":"48000","channels":2,"duration":"9.5"}],"format":{"duration":"","format_name":"ogg"}}',
        '{"streams":[{"codec_type":"video","disposition":{"attached_pic":0},"codec_name":"vp9"}]}', "{", None, "[1]", '"text"', "{}", '{"streams":null,"format":null}', '{"streams":"none","format":{"duration":3}}',
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = {r.i: r.p and tuple(r.p) for r in frame.select("i", media.probe_record(F.col("t")).alias("p")).collect()}
    none = (None, None, False, False, None, None, None, None)
    assert out == {0: (9.5, "ogg", True, False, "opus", 48000, 2, None), 1: (None, None, False, True, None, None, None, "vp9"), 2: None, 3: None, 4: None, 5: None, 6: none, 7: none, 8: (3.0, *none[1:])}


def as_json(v):
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


KIND = "struct<b:string,a:struct<z:array<double>,y:boolean>,m:map<string,bigint>,n:array<struct<q:int,p:string>>>"


def test_canonical_json(spark):
    values = [
        {"b": 'é "quoted" \\ back\n\ttab \x01\x1f/ \x7f 中', "a": {"z": [1.0, 0.1, 1e-05, 0.0001, 123456.789, 1e15, 1e16, 1.5e300, -0.0, 2.5e-7, 12345678.0, -1e22], "y": True}, "m": {"é": 1, "a b": -2, "Z": None}, "n": [{"q": 1, "p": None}, None]},
        {"b": None, "a": None, "m": {}, "n": []},
    ]
    frame = spark.createDataFrame([(v,) for v in values], f"v {KIND}")
    kind = frame.schema["v"].dataType
    assert [r.t for r in frame.select(canonical.canonical_json(F.col("v"), kind).alias("t")).collect()] == [as_json(v) for v in values]
    assert [r.h for r in frame.select(canonical.canonical_hash(F.col("v"), kind, ("m", "b")).alias("h")).collect()] == [hashlib.sha256(as_json({k: x for k, x in v.items() if k not in "mb"}).encode()).hexdigest() for v in values]
    turned = frame.select(F.struct("v.n", "v.m", "v.b", F.struct("v.a.y", "v.a.z").alias("a")).alias("v"))
    first = turned.select(canonical.canonical_json(F.col("v"), turned.schema["v"].dataType).alias("t")).first().t
    assert first == as_json(values[0])
    with pytest.raises(TypeError):
        canonical.canonical_json(F.current_date(), frame.select(F.current_date()).schema[0].dataType)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e30, max_value=1e30), min_size=30, max_size=60))
def test_numbers(spark, values):
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical._number(F.col("v")).alias("t")).collect()
    assert all(float(r.t) == r.v for r in out)
    # digits of 17 places aside, of which a runtime may give one too many, texts are those of the shortest form
    assert all(r.t == repr(r.v) for r in out if len(r.t) < 16)


def small(spark):
    return {
        "lectures": spark.createDataFrame([(1, "a", "READY"), (2, "b", "EMBEDDING"), (3, None, "FAILED"), (4, "a", "CHUNKING")], "lecture_id long, user_id string, status string"),
        "segments": spark.createDataFrame([(1, 10), (2, 11), (2, 12), (3, 13), (77, 14), (None, 15)], "lecture_id long, segment_id long"),
        "jobs": spark.createDataFrame([(1, 100), (2, 101), (4, 102)], "lecture_id long, job_id long"),
        "runs": spark.createDataFrame([(100, 1), (101, 2), (101, 3), (999, 4)], "job_id long, run_id long"),
    }


def test_callers_see_their_own(spark):
    t = small(spark)
    names = access.secure(spark, t["lectures"], {"segments": t["segments"], "jobs": t["jobs"]})
    assert names == ["my_lectures", "my_segments", "my_jobs"]
    see = lambda sql: sorted(tuple(r) for r in spark.sql(sql).collect())
    assert see("SELECT lecture_id FROM my_lectures('a')") == [(1,), (4,)] and see("SELECT segment_id FROM my_segments('b')") == [(11,), (12,)]
    assert see("SELECT * FROM my_segments('nobody')") == [] == see("SELECT * FROM my_lectures(NULL)") == see("SELECT * FROM my_jobs(NULL)")
    seen = [set(see(f"SELECT lecture_id, job_id FROM my_jobs('{c}')")) for c in "ab"]
    assert seen[0] and seen[1] and not seen[0] & seen[1]
    assert see("SELECT s.segment_id FROM my_segments('b') s JOIN my_jobs('b') j USING (lecture_id) WHERE segment_id > 11") == [(12,)]


def test_cascade_leaves_no_orphan(spark):
    graph = [access.Child("segments", "lectures", "lecture_id", "segment_id"), access.Child("jobs", "lectures", "lecture_id", "job_id"), access.Child("runs", "jobs", "job_id", "run_id")]
    t = small(spark)
    left = access.cascade(t, "lectures", "lecture_id", spark.createDataFrame([(2,), (2,), (555,), (None,)], "k long"), graph)
    ids = {n: sorted(r[-1] for r in df.collect()) for n, df in left.items() if n != "lectures"}
    assert ids == {"segments": [10, 13, 14, 15], "jobs": [100, 102], "runs": [1, 4]} and sorted(r.lecture_id for r in left["lectures"].collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        access.cascade(t, "lectures", "lecture_id", t["lectures"], graph[::-1])


def test_failed_lectures_and_retries(spark):
    lectures = small(spark)["lectures"]
    rows = [(i, "running", 3, 3, "2024-01-01 00:00:00", None) for i in (1, 2, 3)] + [(4, "running", 1, 3, "2024-01-01 00:00:00", None)]
    jobs = spark.createDataFrame(rows, "lecture_id long, status string, attempt_count int, max_attempts int, at string, retryable boolean").withColumn("lease_expires_at", F.col("at").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    assert {r.lecture_id: r.status for r in access.fail_lectures(lectures, jobs, now).collect()} == {1: "READY", 2: "FAILED", 3: "FAILED", 4: "CHUNKING"}
    failed = spark.createDataFrame([(1, "failed", 3, 3, True), (2, "failed", 1, 3, False), (3, "failed", 2, 3, True), (4, "queued", 0, 3, None)], "lecture_id long, status string, attempt_count int, max_attempts int, retryable boolean").withColumn("next_attempt_at", F.lit(None).cast("timestamp"))
    owned = lectures.withColumn("user_id", F.coalesce("user_id", F.lit("c"))).withColumn("status", F.lit("FAILED"))
    asked = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c"), (4, "a"), (9, "a")], "lecture_id long, user_id string")
    after, moved, answers = access.retry(failed, owned, asked, now)
    assert {r.lecture_id: r.answer for r in answers.collect()} == {1: "not_found", 2: "not_retryable", 3: "retried", 4: "not_failed", 9: "not_found"}
    assert {r.lecture_id: (r.status, r.max_attempts, r.retryable) for r in after.collect()} == {1: ("failed", 3, True), 2: ("failed", 3, False), 3: ("queued", 5, None), 4: ("queued", 3, None)}
    assert {r.lecture_id: r.status for r in moved.collect()} == {1: "FAILED", 2: "FAILED", 3: "QUEUED", 4: "FAILED"}


def test_overrides(spark):
    rows = [(1, "rag_top_k", " 10 "), (1, "rag_min_similarity", "0.5"), (1, "llm_model", "m"), (2, "database_url", "x"), (2, "rag_top_k", "ten"), (2, None, "1"), (3, "rag_context_tokens", None)]
    out = {r.config: r for r in ablation.typed_overrides(spark.createDataFrame(rows, "config int, key string, raw string")).collect()}
    assert (out[1].rag_top_k, out[1].rag_min_similarity, out[1].llm_model, out[1].refused) == (10, 0.5, "m", [])
    assert out[2].refused == ["", "database_url", "rag_top_k"] and out[2].rag_top_k is None and out[3].refused == ["rag_context_tokens"]


def test_grid_equals_a_run_for_each_configuration(spark):
    chunks = spark.createDataFrame([(i, 1, i, "m", [1.0, i / 10]) for i in range(12)], "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>")
    q = chunks.where("chunk_id < 6").select(F.col("chunk_id").alias("query_id"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))
    tokens = chunks.select("chunk_id", (F.col("chunk_id") * 7 % 11 + 1).cast("int").alias("token_estimate"))
    answers = q.select("query_id", (F.col("query_id") % 2 == 0).alias("answerable"), F.array((F.col("query_id") % 4).cast("int")).alias("cited"), F.when(F.col("query_id") != 5, "a").alias("answer"))
    sweeps = spark.createDataFrame([("x", 4, 0.995, 12), ("y", 2, 0.9, 30), ("z", None, 1.1, None)], "config string, rag_top_k int, rag_min_similarity double, rag_context_tokens int")
    configs = ablation.grid(sweeps)
    whole = sorted(map(tuple, ablation.run_grid(q, chunks, tokens, answers, configs, 8).collect()))
    assert len(whole) == 24 and configs.count() == 24
    single = []
    for c in configs.collect():
        one = spark.createDataFrame([c], configs.schema)
        single += map(tuple, ablation.run_grid(q, chunks, tokens, answers, one, c.rag_top_k).collect())
    assert sorted(single) == whole
    by = {r[:4]: r for r in whole}
    assert by["z", True, True, True][4:8] == (6, 0, 0, 6) and by["z", False, False, False][6] == 5
