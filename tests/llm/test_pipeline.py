import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == columns for d in kept[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[1]) < len(ids[0]) and len(ids[3]) < len(ids[2])
    assert kept[-1].where("not round_trip").isEmpty() and kept[-1].count() == kept[-2].count()
    assert kept[3].groupBy("text").count().where("count > 1").isEmpty()


def test_odd_rows(spark):
    rows = [(None, None, "en", None, None), (1, "", "en", "a", 0), (2, "Ten words are in this line, and it has an end.", None, "a", 46), (2, "Ten words are in this line, and it has an end.", None, "a", 46)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for _, stage in pipeline.STAGES:
        for d in (docs, docs.where("doc_id > 9")):
            assert stage(spark, d, SF).count() <= 2 * d.count()
