"""Writes as plans: what a table holds after an insert, a delete or a replacement, and what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table with those new rows whose key it doesn't have, and the rows in conflict. A key given twice is taken once."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys)
    ranked = new.withColumn("__nth", F.row_number().over(order))
    fresh = ranked.where("__nth = 1").drop("__nth").join(old.select(*keys), keys, "left_anti").select(*new.columns)
    conflicts = ranked.join(old.select(*keys, F.lit(True).alias("__held")).distinct(), keys, "left").where("__held or __nth > 1").select(*new.columns)
    return old.unionByName(fresh), conflicts


def delete_rows(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true: unknown ones stay."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def replace_partitions(new: DataFrame, path: str, by: str) -> None:
    """Writes new over the partitions it has rows for; others stay. Running it again changes nothing."""
    new.repartition(by).write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def touched(new: DataFrame, changed: Column, now: Column) -> DataFrame:
    return new.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))


def profiles(accounts: DataFrame) -> DataFrame:
    """accounts (id, metadata JSON): the profile that goes with each, its name trimmed and cut, NULL where there is none."""
    name = F.trim(F.get_json_object("metadata", "$.full_name"))
    return accounts.select("id", F.nullif(F.substring(name, 1, 120), F.lit("")).alias("display_name"))


def annotation_template(results: DataFrame, questions: DataFrame) -> DataFrame:
    """results (run_id, question_id, outcome, answer, sources: array of (start_seconds, end_seconds, text, cited)): a row to fill in for each."""
    cited = F.filter(F.coalesce("sources", F.array().cast("array<struct<start_seconds:double,end_seconds:double,text:string,cited:boolean>>")), lambda s: s["cited"])
    passages = F.array_join(F.transform(cited, lambda s: F.format_string("[%.0f-%.0fs] %s", s["start_seconds"], s["end_seconds"], s["text"])), " || ")
    out = results.join(questions, "question_id")
    blank = [F.lit("").alias(c) for c in ("correctness_label", "citation_support_label", "annotator", "notes")]
    return out.select(
        "run_id", "question_id", "answerable", "question", F.coalesce("reference_answer", F.lit("")).alias("reference_answer"), "outcome", F.coalesce("answer", F.lit("")).alias("generated_answer"), passages.alias("cited_passages"), *blank
    )


def label_rows(sheet: DataFrame) -> DataFrame:
    """A filled-in sheet as judgments: one row for each label that isn't blank."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(F.coalesce(c, F.lit(""))).alias("label")) for k, c in (("correctness", F.col("correctness_label")), ("citation_support", F.col("citation_support_label")))])
    return sheet.select("run_id", "question_id", F.explode(kinds).alias("j"), F.trim(F.coalesce("annotator", F.lit(""))).alias("annotator"), "notes").where("j.label <> ''").select("run_id", "question_id", "j.kind", "j.label", "annotator", "notes")


def deletion_plan(orphans: DataFrame, batch: int = 100) -> DataFrame:
    """orphans (path, reason) with the number of their batch. Deleting is left to the caller.

    Batches are numbered within an owner, so that no window spans the table."""
    owner = F.split("path", "/")[0]
    nth = F.row_number().over(Window.partitionBy(owner).orderBy("path")) - 1
    return orphans.where("reason is not null").select("path", "reason", owner.alias("owner"), F.floor(nth / batch).cast("long").alias("batch"))


def greedy_groups(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """rows with `group_no`: consecutive rows of a key that fit the budget together; a row above it is a group of its own.

    A fold in order of (key, order) over sorted partitions, in batches: no key is held whole."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(rows.schema.fields + [T.StructField("group_no", T.LongType())])

    def run(batches):
        last, used, group = None, 0, 0
        for pdf in batches:
            numbers = []
            for k, c in zip(pdf[key], pdf[cost]):
                if k != last:
                    last, used, group = k, 0, 0
                elif used and used + c > budget:
                    used, group = 0, group + 1
                used += c
                numbers.append(group)
            yield pdf.assign(group_no=pd.array(numbers, dtype="int64"))

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
