"""Reduction of a lecture's part notes, level by level, around functions that are given: one makes a note of each part, one
merges consecutive notes. While a lecture's notes together exceed the budget, those that fit it together are merged; a
lecture whose notes can't be combined any more stops, whatever its size. A level is one plan over all lectures that are
still too large, and is written before the next begins, so lineage doesn't grow with the levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions.display import json_tokens
from marlpit.operators.writes import greedy_groups
from marlpit.sources.files import work_dir

#: (lecture_id, group_no, notes: array of JSON texts in order) -> (lecture_id, group_no, note: a JSON text)
Merge = Callable[[DataFrame], DataFrame]


def _list_tokens(length: Column, n: Column) -> Column:
    """Tokens of a JSON list of n texts of this length in all: brackets, and a comma and a space between two."""
    return F.greatest(F.lit(1), F.floor((length + 2 + 2 * (n - 1)) / 3)).cast("long")


def _sizes(notes: DataFrame) -> DataFrame:
    return notes.groupBy("lecture_id").agg(F.count("*").alias("n"), F.sum(F.length("note")).alias("length"))


def reduce_notes(notes: DataFrame, merge: Merge, budget: int) -> DataFrame:
    """notes (lecture_id, part, note: JSON text) -> (lecture_id, part, note, levels, complete): what is left of each lecture's notes,
    part being the given one, or the number from 0 of the group that it was merged from; levels, how often they were merged; complete, whether they fit the budget together now."""
    spark = notes.sparkSession
    folder, level, done = work_dir(spark, "notes"), 0, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}{level}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}{level}")

    now = kept(notes.select("lecture_id", F.col("part").cast("long").alias("part"), "note"), "notes")
    while True:
        sized = _sizes(now).select("lecture_id", "n", (_list_tokens(F.col("length"), F.col("n")) > budget).alias("large"))
        costed = now.join(sized.where("large").select("lecture_id", "n"), "lecture_id").withColumn("cost", json_tokens(F.col("note")))
        grouped = greedy_groups(costed, "lecture_id", "part", "cost", budget)
        members = grouped.groupBy("lecture_id", "n", "group_no").agg(F.sort_array(F.collect_list(F.struct("part", "note"))).alias("members"))
        members = kept(members.select("lecture_id", "n", "group_no", F.transform("members", lambda m: m["note"]).alias("notes")), "groups")
        moving = members.groupBy("lecture_id", "n").agg(F.count("*").alias("groups")).where("groups < n").select("lecture_id")
        done.append(now.join(moving, "lecture_id", "left_anti").join(sized.select("lecture_id", (~F.col("large")).alias("complete")), "lecture_id").withColumn("levels", F.lit(level)))
        if moving.isEmpty():
            break
        on = members.join(moving, "lecture_id", "left_semi").drop("n")
        merged = merge(on.where(F.size("notes") > 1)).select("lecture_id", "group_no", "note")
        single = on.where(F.size("notes") == 1).select("lecture_id", "group_no", F.get("notes", 0).alias("note"))
        level += 1
        now = kept(merged.unionByName(single).select("lecture_id", F.col("group_no").alias("part"), "note"), "notes")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("lecture_id", "part", "note", "levels", "complete")
