"""Grounding goes over the items twice, once for keywords and once for the others."""

from marlpit.operators import grounding


def test_items_are_gone_over_twice(spark, tmp_path):
    rows = [(1, "keywords", 3, "Cell", ["0"]), (1, "keywords", 2, "cELL ", ["9"]), (1, "keywords", 1, "absent", ["0"]), (2, "keywords", 0, "cell", ["0"]), (3, "keywords", 0, "cell", ["0"])]
    rows += [(1, "definitions", p, "cell" if p > 29 else "absent", ["1", "x", "0", "1"]) for p in range(32)] + [(1, "points", 0, " a \n b", ["7"]), (1, "points", 1, " a \n b", ["1", "x", "0", "1"]), (2, "points", 0, "a", ["0"])]
    spark.createDataFrame(rows, "lecture_id long, kind string, position long, term string, raw_refs array<string>").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame([(1, 2, "A CELL divides"), (2, 1, None)], "lecture_id long, n_chunks int, text string").write.parquet(f"{tmp_path}/lectures")
    items, lectures = spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/lectures")
    out = grounding.ground_items(items, lectures)
    # 30 definitions count, and none of them is in the text; the keyword is its first, without a valid reference.
    assert sorted(map(tuple, out.collect())) == [(1, "keywords", 2, "cELL", []), (1, "points", 1, "a b", [0, 1]), (2, "points", 0, "a", [0])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "raw_refs" in x for x in plan.split("\n")) == 2
    assert "collect_list" not in plan
