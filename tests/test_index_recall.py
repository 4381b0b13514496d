"""Recall is told from the places of cells, and is that of real searches."""

import numpy as np
from marlpit.operators.retrieval import similarities
from marlpit.operators.vector_index import VectorIndex


def test_recall_runs_no_search(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, i % 7, i, "m", rng.normal(size=6).tolist()) for i in range(300)]
    spark.createDataFrame(rows, "chunk_id long, lecture_id long, sequence long, embedding_model string, embedding array<double>").write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    queries = chunks.where("chunk_id % 30 = 0").selectExpr("chunk_id as query_id", "embedding_model as query_model", "embedding as query")
    index = VectorIndex.build(chunks, f"{tmp_path}/index", lists=6)
    exact = {(r.query_id, r.chunk_id) for r in similarities(queries, chunks, 5).collect()}
    found = {p: {(r.query_id, r.chunk_id) for r in index.search(queries, 5, p).collect()} for p in (1, 3, 6)}
    monkeypatch.setattr(VectorIndex, "search", None)
    shares = index.recall(queries, chunks, 5, [1, 3, 6])
    assert shares == {p: len(exact & f) / len(exact) for p, f in found.items()} and shares[1] < shares[6] == 1
