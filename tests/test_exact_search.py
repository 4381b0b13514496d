"""The exact search of blocks against the plain one."""

import math
import random

from marlpit.operators import retrieval

CHUNKS = "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>"


def plain(rows, asked, top):
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    out = set()
    for q, model, v in asked:
        near = []
        for c, _, sequence, m, w in rows:
            if m == model and w is not None and len(w) == len(v) and None not in w and norm(w) * norm(v) > 0:
                similarity = sum(a * b for a, b in zip(w, v)) / (norm(w) * norm(v))
                if not math.isnan(similarity):
                    near.append((-similarity, sequence, c))
        out |= {(q, rank, c) for rank, (_, _, c) in enumerate(sorted(near)[:top], 1)}
    return out


def test_blocks_give_the_plain_result_and_no_pair_is_a_row(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    rng = random.Random(3)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(300)]
    vectors[:60] = [[1.0, 2.0, 0.0, 1.0]] * 60
    vectors[60:68] = [None, [0.0] * 4, [1.0, None, 2.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [float("nan")] * 4, [1e-150, 2e-150, 0.0, 1e-150], [1e200, 2e200, 0.0, 0.0], [1.0, 2.0, 0.0]]
    rows = [(i, i % 5, (i * 7) % 50, ["a", "b", None][i % 11 % 3], v) for i, v in enumerate(vectors)]
    asked = [(i, m, v) for i, _, _, m, v in rows if i % 6 == 0 and m and v and None not in v]
    chunks = spark.createDataFrame(rows, CHUNKS)
    near = retrieval.similarities(spark.createDataFrame(asked, "query_id long, query_model string, query array<double>"), chunks, 9)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in near.collect()} == plain(rows, asked, 9)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    none = retrieval.similarities(spark.createDataFrame(asked, "query_id long, query_model string, query array<double>").where("query_id < 0"), chunks, 9)
    assert none.count() == 0
