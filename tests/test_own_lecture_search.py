"""The search of a query's own lecture, in blocks, against the plain one."""

import random

import pytest
from marlpit.operators import retrieval
from test_exact_search import CHUNKS, plain


@pytest.mark.parametrize(("chunk_block", "query_block"), [(40, 7), (8192, 4096)])
def test_own_lecture_gives_the_plain_result_and_no_pair_is_a_row(spark, monkeypatch, chunk_block, query_block):
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", chunk_block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    rng = random.Random(3)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(400)]
    vectors[:60] = [[1.0, 2.0, 0.0, 1.0]] * 60
    vectors[60:68] = [None, [0.0] * 4, [1.0, None, 2.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [float("nan")] * 4, [1e-150, 2e-150, 0.0, 1e-150], [1e200, 2e200, 0.0, 0.0], [1.0, 2.0, 0.0]]
    # One lecture holds half of the chunks, one only chunks, some few, and some chunks are in none.
    lecture = [0 if i % 2 else [9, 1, 2, 3, 4, 5, None][i % 7] for i in range(400)]
    rows = [(i, lecture[i], (i * 7) % 50, ["a", "b", None][i % 11 % 3], v) for i, v in enumerate(vectors)]
    asked = [(i, of, m, v) for i, of, _, m, v in rows if i % 3 == 0 and of != 9 and m and v and None not in v] + [(1000 + i, 77, "a", [1.0] * 4) for i in range(30)]
    expected = set()
    for of in {*lecture} - {None}:
        expected |= plain([r for r in rows if r[1] == of], [(i, m, v) for i, x, m, v in asked if x == of], 4)
    near = retrieval.similarities(spark.createDataFrame(asked, "query_id long, query_lecture long, query_model string, query array<double>"), spark.createDataFrame(rows, CHUNKS), 4, own_lecture=True)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in near.collect()} == expected and len(expected) > 200
    assert "FlatMapCoGroupsInArrow" in near._jdf.queryExecution().optimizedPlan().toString()
