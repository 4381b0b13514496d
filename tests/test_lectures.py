from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.operators import chunking, cleaning, jobs, metrics, retrieval, wer


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, cleaned",
    [(" Rivers   carry\tsand , silt and clay ;  ", "Rivers carry sand, silt and clay;"), ("( a ) b", "(a) b"), ("", ""), ("cafe\u0301", "caf\u00e9")],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, tx.clean(F.col("t")), t=raw) == cleaned


def segments(spark, texts, speech=None):
    rows = [(1, i, i * 5.0, i * 5.0 + 4.5, t, *((speech or {}).get(i, (0.0, 0.0)))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "lecture_id long, sequence long, start_seconds double, end_seconds double, raw_text string, no_speech_prob double, avg_logprob double")


def test_capitals_follow_sentences(spark):
    out = cleaning.clean_segments(segments(spark, ["the delta grows", "every spring.", "then it"])).orderBy("sequence").collect()
    assert [r.text for r in out] == ["The delta grows", "every spring.", "Then it"]


def test_repeats_silence_and_duplicates(spark):
    texts = ["Silt. Silt. silt. Silt.", "Slow, slow water.", "Mud.", "Mud", "noise", "Clay.", None, "Sand. Sand. Loam.", "-! -! -!", "Peat.\n"]
    out = {r.sequence: r for r in cleaning.clean_segments(segments(spark, texts, {4: (0.93, -1.4), 5: (0.5, -1.5)})).collect()}
    assert out[0].text == "Silt." and out[0].n_collapsed == 3
    assert out[1].text == "Slow, slow water." and out[1].n_collapsed == 0
    assert [out[i].reason for i in (2, 3, 4, 5, 6)] == ["kept", "duplicate", "non_speech", "kept", "empty"]
    assert out[7].text == "Sand. Sand. Loam."
    # Repeats in a segment that is empty after all count; white space at the ends is no change.
    assert out[8].reason == "empty" and out[8].n_collapsed == 2
    counts = cleaning.cleaning_counts(cleaning.clean_segments(segments(spark, ["Peat.\n", "-! -! -!"]))).first()
    assert (counts.n_changed, counts.n_collapsed) == (0, 2)


def runs_by_hand(words):
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and words[j].lower() == words[i].lower():
            j += 1
        out += words[i : i + 1] if j - i >= 3 else words[i:j]
        i = j
    return out


def test_collapse_runs_as_by_hand(spark):
    import random

    rng = random.Random(5)
    cases = [[rng.choice(["a", "A", "b"]) for _ in range(rng.randrange(12))] for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    got = {r.i: r.k for r in df.select("i", cleaning.collapse_runs(F.col("s")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [runs_by_hand(c) for c in cases]


def test_chunks(spark):
    words = " ".join(["word"] * 29)
    segs = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 4.5, f"{words} end.") for i in range(60)], "lecture_id long, sequence long, start_seconds double, end_seconds double, text string")
    out = chunking.build_chunks(segs).orderBy("chunk").collect()
    assert len(out) > 3 and all(200 <= r.token_estimate <= 460 for r in out[:-1]) and all(r.text.endswith(".") for r in out)
    assert {i for r in out for i in range(r.first_segment, r.last_segment + 1)} == set(range(60))
    small = chunking.build_chunks(segs.where("sequence < 2")).collect()
    assert len(small) == 1 and (small[0].start_seconds, small[0].end_seconds) == (0.0, 9.5)
    with pytest.raises(ValueError):
        chunking.build_chunks(segs, 400, 200, 50)
    windows = chunking.llm_windows(chunking.build_chunks(segs), budget=900).collect()
    assert sum(w.n_chunks for w in windows) == len(out) and all(w.cost <= 900 or w.n_chunks == 1 for w in windows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _row(row, i, x, b)
    return row[-1]


def _row(old, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(old[j - 1] + (x != y), old[j] + 1, new[j - 1] + 1))
    return new


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
@settings(max_examples=200, deadline=None)
def test_alignment_has_the_least_edits(a, b):
    s, d, i = wer.alignment(a, b)
    assert s + d + i == edits(a, b) and len(a) - d + i == len(b)


def test_error_rates(spark):
    rows = [(1, "p q r s", "p r s t"), (2, "one red kite", "one tan kite"), (3, "", "x"), (4, "Er, rock,paper \u2010 well\u2010known [wind] it\u02bcs “ﬁne”!", "rock paper well known it's fine"), (5, None, None)]
    out = {r.id: r for r in wer.error_counts(spark.createDataFrame(rows, "id long, reference string, hypothesis string")).collect()}
    assert [(out[i].errors, out[i].n_words, out[i].wer) for i in (1, 2, 3, 4)] == [(2, 4, 0.5), (1, 3, 0.333333), (1, 0, None), (0, 6, 0.0)]
    assert wer.alignment("p q r s".split(), "p r s t".split()) == (0, 1, 1)
    total = wer.corpus_rates(wer.error_counts(spark.createDataFrame([(1, "u v", "u w"), (2, "k l m n", "k l m n")], "id long, reference string, hypothesis string"))).first()
    assert (total.errors, total.n_words, total.wer, total.char_errors, total.n_chars) == (1, 6, 0.166667, 1, 6)


def test_retrieval_scores(spark):
    ranked = spark.createDataFrame([(1, 1, 0.0, 60.0), (1, 2, 300.0, 360.0), (1, 3, 110.0, 170.0), (1, 4, 500.0, 560.0)], "question_id long, rank int, start_seconds double, end_seconds double")
    spans = spark.createDataFrame([(1, 0, 120.0, 140.0), (1, 1, 510.0, 520.0)], "question_id long, span_no int, gold_start double, gold_end double")
    at = lambda cut, tol: metrics.retrieval_scores(ranked, spans, cut, tol).first()
    assert at(1, 0.0).hit == 0 and at(3, 0.0).hit == 1 and at(3, 0.0).recall == 0.5 and at(4, 0.0).recall == 1.0
    assert at(3, 0.0).reciprocal_rank == 0.333333 and at(3, 0.0).timestamp_hit == 0 and at(3, 30.0).timestamp_hit == 1


def test_kappa_abstention_latency(spark):
    k = metrics.cohen_kappa(spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, "y", "y"), (4, "y", "y")], "item long, rater_a string, rater_b string")).first()
    assert (k.n, k.agreement, k.kappa) == (4, 0.75, 0.5)
    rows = [(True, "answered"), (True, "insufficient_evidence"), (False, "insufficient_evidence"), (False, "answered"), (False, "insufficient_evidence")]
    a = metrics.abstention(spark.createDataFrame(rows, "answerable boolean, outcome string")).first()
    assert (a.precision, a.recall, a.false_refusal, a.answered_unanswerable) == (0.666667, 0.666667, 0.5, 0.333333)
    l = spark.createDataFrame([(100,), (200,), (None,), (300,), (400,)], "ms long").agg(*metrics.latency("ms")).first()
    assert (l.n, l.n_missing, l.median, l.p90) == (4, 1, 250.0, 400)


def test_evidence_budget(spark):
    ranked = spark.createDataFrame([(1, 10, 0, 0.62, 3), (1, 11, 1, 0.81, 4), (1, 12, 2, 0.40, 1)], "query_id long, chunk_id long, sequence long, similarity double, token_estimate int")
    got = lambda budget, t=0.6: [(r.sequence, r.number) for r in retrieval.evidence(ranked, t, budget).orderBy("sequence").collect()]
    assert got(100) == [(0, 1), (1, 2)] and got(5) == [(1, 1)] and got(100, 0.9) == []


def test_search_guards(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "m", [1.0, 0.0]), (2, 1, 1, "m", [0.0, 0.0]), (3, 1, 2, "m", None), (4, 1, 3, "other", [1.0, 0.0]), (5, 1, 4, "m", [1.0, 0.0, 0.0]), (6, 1, 5, "m", [1.0, 1.0])], "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>")
    q = spark.createDataFrame([(9, "m", [1.0, 0.0])], "query_id long, query_model string, query array<double>")
    assert [(r.chunk_id, r.similarity) for r in retrieval.similarities(q, chunks, 5).select("chunk_id", retrieval.shown(), "rank").orderBy("rank").collect()] == [(1, 1.0), (6, 0.7071)]
    # Ranks look at the exact value: these two differ in the sixth place.
    near = spark.createDataFrame([(1, 1, 0, "m", [1.0, 0.002]), (2, 1, 1, "m", [1.0, 0.0])], "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>")
    assert [r.chunk_id for r in retrieval.similarities(q, near, 5).orderBy("rank").collect()] == [2, 1]


def test_answers(spark):
    rows = [(1, "true", ["2", "9", "x"], " a  b "), (2, "true", ["7"], "a"), (3, "yes", ["1"], "a"), (4, "true", ["1"], "  "), (5, "true", None, "a")]
    a = spark.createDataFrame(rows, "id int, answerable string, citations array<string>, answer string")
    out = {r.id: (r.decision, r.cited, r.shown_answer) for r in retrieval.interpret(a, F.lit(3)).collect()}
    assert out == {1: ("answered", [2], "a b"), 2: ("no_valid_citations", [], None), 3: ("model_declined", [], None), 4: ("model_declined", [], None), 5: ("no_valid_citations", [], None)}
    free = {r.id: r.decision for r in retrieval.interpret(a, F.lit(3), use_answerable=False, require_citations=False).collect()}
    assert free == {1: "answered", 2: "answered", 3: "answered", 4: "model_declined", 5: "answered"}


def test_chapters(spark):
    from marlpit.operators import grounding

    chunks = spark.createDataFrame([(1, c, c * 60.0, c * 60.0 + 58) for c in (0, 1, 2, 4, 5, 6)], "lecture_id long, chunk long, start_seconds double, end_seconds double")
    proposed = spark.createDataFrame([(1, 5, "Ends"), (1, 1, "Starts"), (1, 3, "no such chunk"), (1, 42, "x"), (1, 2, " "), (1, 1, "Zeta")], "lecture_id long, start_chunk long, title string")
    out = [(r.chapter, r.title, r.first_chunk, r.last_chunk, r.start_seconds, r.end_seconds) for r in grounding.chapters(proposed, chunks).orderBy("chapter").collect()]
    assert out == [(0, "Starts", 0, 4, 0.0, 298.0), (1, "Ends", 5, 6, 300.0, 418.0)]


def test_display(spark):
    from marlpit.functions import display as d

    assert one(spark, d.tidy(F.col("t")), t="uh, so I- I think , it's non-linear,, um. yes") == "So I think, it's non-linear, yes"
    assert one(spark, d.paragraphs(F.col("t")), t="One.\n \n Two. ") == ["One.", "Two."]
    long = " ".join(f"Sentence {i} {'x' * 60}." for i in range(7))
    assert [p.count(".") for p in one(spark, d.paragraphs(F.col("t")), t=long)] == [3, 3, 1]
    assert [one(spark, d.playback_bitrate(F.col("t")), t=t) for t in (0.0, 60.0, 10_000.0, 20_000.0)] == [48, 48, 39, None]


def test_policies():
    from marlpit.operators import checks

    checks.check_run_policy("dev", False, True)
    checks.check_purpose("smoke", 3)
    checks.check_judge(("a/", "m"), ("b", "m"))
    for call in (lambda: checks.check_run_policy("test", False, False), lambda: checks.check_run_policy("test", True, True), lambda: checks.check_purpose("benchmark", 3), lambda: checks.check_purpose("smoke", None), lambda: checks.check_purpose("x", 1), lambda: checks.check_judge(("a/", "m"), ("a", "m"))):
        with pytest.raises(ValueError):
            call()


def test_files(spark, tmp_path):
    import io
    import tarfile

    from marlpit.operators import writes
    from marlpit.sources import archives, files

    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "a int").count() == 0
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "o/u1/l1").mkdir(parents=True)
    (tmp_path / "o/u1/l1/x.txt").write_text("two\nlines")
    assert [(r.path, r.size) for r in files.list_objects(spark, f"file://{tmp_path}/o").collect()] == [("u1/l1/x.txt", 9)]
    assert files.read_text(spark, f"file://{tmp_path}/o/u1/l1").first().text == "two\nlines"
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as tar:
        for name, body in (("S/dev/1/1.trans.txt", b"1-0 one two\n1-1 three\n"), ("S/dev/1/1-0.flac", b"x"), ("S/dev/1/1-2.flac", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    got = sorted((r.id, r.subset, r.text, r.has_audio) for r in archives.read_speech_archive(spark, f"file://{tmp_path}/s.tar.gz").collect())
    assert got == [("1-0", "dev", "one two", True), ("1-1", "dev", "three", False), ("1-2", "dev", None, True)]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 4, 3, 20, 1])] + [(2, 0, 9)], "k long, o long, cost long")
    assert [r.group_no for r in writes.greedy_groups(rows, "k", "o", "cost", 10).orderBy("k", "o").collect()] == [0, 0, 1, 2, 3, 0]


def test_rate_limit_and_leases(spark):
    rows = [(1, "ask", "u", datetime(1970, 1, 1, 0, 16, 40)), (2, "ask", "u", datetime(1970, 1, 1, 0, 16, 40)), (3, "ask", "u", datetime(1970, 1, 1, 0, 16, 40)), (4, "ask", "u", datetime(1970, 1, 1, 0, 16, 40)), (5, "ask", "v", datetime(1970, 1, 1, 0, 16, 40)), (6, "ask", "u", datetime(1970, 1, 1, 0, 17, 1))]
    out = {r.id: r for r in jobs.rate_limited(spark.createDataFrame(rows, "id long, operation string, subject string, at timestamp"), 3, 60).collect()}
    assert [out[i].allowed for i in range(1, 7)] == [True, True, True, False, True, True] and out[4].retry_after == 20
    j = spark.createDataFrame([(1, "running", 3), (2, "running", 1)], "job_id long, status string, attempt_count int").select("*", F.lit(3).alias("max_attempts"), F.lit("2024-01-01").cast("timestamp").alias("lease_expires_at"), F.lit("2024-01-01").cast("timestamp").alias("next_attempt_at"))
    got = {r.job_id: (r.status, r.lecture_status) for r in jobs.recover(j, F.lit("2024-01-02").cast("timestamp")).collect()}
    assert got == {1: ("failed", "FAILED"), 2: ("queued", None)}


def test_without_training_data_operators():
    """The entry imports where the training-data folders are gone."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tempfile.mkdtemp(prefix="spark-")
    shutil.copytree(f"{root}/marlpit", f"{to}/marlpit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", to)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=to, env=os.environ | {"PYTHONPATH": to}, capture_output=True, text=True)
    n, has, m = said.stdout.split()
    assert int(n) > 50 and has == "False" and int(m) > 50
