import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.operators import retrieval
from marlpit.operators.vector_index import VectorIndex
from marlpit.plans import search
from marlpit.sources import files

SF = "/root/testdata/sf0.001"


def chunk_rows(rng):
    middles = rng.normal(size=(12, 24))
    rows = [(i, int(i % 5), i % 97, "a" if i % 6 else "b", (middles[i % 12] + 0.4 * rng.normal(size=24)).tolist()) for i in range(1500)]
    # one hot direction with ties, another length, and vectors that are like nothing
    rows += [(2000 + i, 1, i, "a", middles[0].tolist()) for i in range(700)]
    rows += [(4000 + i, 2, i, "a", [1.0, float(i), 2.0]) for i in range(30)]
    return rows + [(5000, 3, 0, "a", None), (5001, 3, 1, "a", [0.0] * 24), (5002, 3, 2, "a", [float("nan")] * 24), (5003, 3, 3, None, middles[1].tolist()), (5004, 3, 4, "a", [None] + [1.0] * 23)]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = chunk_rows(np.random.default_rng(3))
    return spark.createDataFrame(rows, "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, chunks):
    from marlpit.operators import vector_index

    before, vector_index.BLOCK = vector_index.BLOCK, 128
    yield VectorIndex.build(chunks, files.work_dir(spark, "index"), lists=16)
    vector_index.BLOCK = before


def queries_of(chunks):
    some = chunks.where("chunk_id % 50 = 0 or chunk_id >= 5000")
    return some.select(F.col("chunk_id").alias("query_id"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))


def by_hand(chunks, top, lectures=None):
    rows = [(r.chunk_id, r.sequence, r.embedding_model, np.array(r.embedding), r.lecture_id) for r in chunks.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    out = {}
    for i, _, model, v, _ in rows:
        if (i % 50 == 0 or i >= 5000) and model is not None:
            near = [(-float(w @ v / np.sqrt(w @ w) / np.sqrt(v @ v)), s, j) for j, s, m, w, l in rows if m == model and len(w) == len(v) and (lectures is None or l in lectures)]
            out[i] = sorted((round(a, 12), s, j) for a, s, j in near)[:top]
    return out


def test_all_lists_is_the_exact_search(spark, chunks, index):
    for lectures in (None, [1, 2]):
        frame = None if lectures is None else spark.createDataFrame([(l,) for l in [*lectures, 1, 77]], "lecture_id long")
        out = {}
        for r in index.search(queries_of(chunks), 7, index.lists, frame).collect():
            out.setdefault(r.query_id, []).append((r.rank, round(-r.similarity, 12), r.chunk_id))
        expected = by_hand(chunks, 7, lectures)
        assert {q: [(a, j) for _, a, j in sorted(v)] for q, v in out.items()} == {q: [(a, j) for a, _, j in v] for q, v in expected.items() if v}


def test_recall_grows_with_probes_and_few_find_most(chunks, index):
    shares = index.recall(queries_of(chunks), chunks, 10, [1, 4, 16])
    assert shares[1] <= shares[4] <= shares[16] == 1.0
    probes, recall = index.calibrate(queries_of(chunks), chunks, 10)
    assert recall >= 0.9 and probes <= 8


def test_no_row_is_a_pair(chunks, index):
    plan = index.search(queries_of(chunks), 5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") >= 1
    blocks = index.blocks()
    assert blocks.agg(F.max(F.size("rows"))).first()[0] < 3 * 128 and blocks.where("size(rows) > 0").count() > 16


def test_a_reopened_index(spark, chunks, index):
    again = VectorIndex(spark, index.folder)
    first, second = (sorted(map(tuple, i.search(queries_of(chunks), 3, 2).select("query_id", "rank", "chunk_id").collect())) for i in (index, again))
    assert first == second and first


def test_an_empty_index(spark, chunks):
    none = VectorIndex.build(chunks.where("chunk_id < 0"), files.work_dir(spark, "index"))
    assert none.lists == 0 and none.search(queries_of(chunks), 3, 1).count() == 0


def test_most_chunks_of_a_search(spark):
    rows = [(i, 1, i, "a", [1.0, i / 1000]) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>")
    q = chunks.where("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), F.col("lecture_id").alias("query_lecture"), F.col("embedding_model").alias("query_model"), F.col("embedding").alias("query"))
    library, lecture = q.drop("query_lecture"), q
    assert [retrieval.similarities(library, chunks, k).count() for k in (0, 51, 100, 101)] == [1, 51, 100, 100]
    assert [retrieval.similarities(lecture, chunks, k, own_lecture=True).count() for k in (0, 50, 51, 100)] == [1, 50, 50, 50]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_measures_its_recall(spark):
    out = search.vector_index_search(spark, SF)
    assert out.where("measured_recall < 0.9 or probes > lists").isEmpty() and out.groupBy("query_id").count().where("count > 10").isEmpty()
