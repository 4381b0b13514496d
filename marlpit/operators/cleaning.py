"""Transcript cleaning: repeated sentences, non-speech, duplicate segments, capitals. Windows over the segments of a lecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions import text as tx

NO_SPEECH, LOW_LOGPROB = 0.8, -1.0


def collapse_runs(sentences: Column) -> Column:
    """An array of sentences with runs of three or more equal ones (case aside) cut to their first; equal ones in shorter runs stay.

    Of such a run, a sentence goes if it equals the one before, and either that equals the one before it or it equals the next."""
    low = F.transform(sentences, F.lower)
    n = F.size(sentences)
    none = F.array(F.lit(None).cast("string"))
    one, two = F.concat(none, F.slice(low, 1, n)), F.concat(none, none, F.slice(low, 1, n))
    near = F.arrays_zip(sentences.alias("s"), low.alias("here"), one.alias("one"), two.alias("two"), F.slice(low, 2, n).alias("next"))
    gone = lambda x: F.coalesce((x["here"] == x["one"]) & (F.coalesce(x["one"] == x["two"], F.lit(False)) | F.coalesce(x["here"] == x["next"], F.lit(False))), F.lit(False))
    return F.transform(F.filter(near, lambda x: x["here"].isNotNull() & ~gone(x)), lambda x: x["s"])


def clean_segments(segments: DataFrame) -> DataFrame:
    """segments (lecture_id, sequence, raw_text, no_speech_prob, avg_logprob) with text, reason and n_collapsed.

    reason: non_speech, empty or duplicate, for which text is empty, or kept. A duplicate equals the last segment that is
    neither non-speech nor empty. A kept segment begins with a capital unless the kept one before it ended inside a sentence."""
    order = Window.partitionBy("lecture_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    out = segments.withColumn("cleaned", tx.clean(F.col("raw_text")))
    out = out.withColumn("sentences", F.split("cleaned", r"(?<=[.!?])\s+"))
    out = out.withColumn("fewer", collapse_runs(F.col("sentences")))
    out = out.withColumn("n_collapsed", (F.size("sentences") - F.size("fewer")).cast("long")).withColumn("cleaned", F.array_join("fewer", " "))
    out = out.withColumn("key", tx.dedup_key(F.col("cleaned")))
    silent = F.coalesce((F.col("no_speech_prob") >= NO_SPEECH) & (F.col("avg_logprob") <= LOW_LOGPROB), F.lit(False))
    out = out.withColumn("reason0", F.when(silent, "non_speech").when(F.col("key") == "", "empty"))
    before = F.last(F.when(F.col("reason0").isNull(), F.col("key")), ignorenulls=True).over(order)
    out = out.withColumn("reason", F.coalesce("reason0", F.when(F.col("key") == before, "duplicate"), F.lit("kept")))
    closed = F.last(F.when(F.col("reason") == "kept", tx.ends_sentence(F.col("cleaned"))), ignorenulls=True).over(order)
    text = F.when(F.coalesce(closed, F.lit(True)), tx.capitalise(F.col("cleaned"))).otherwise(F.col("cleaned"))
    out = out.withColumn("text", F.when(F.col("reason") == "kept", text).otherwise(""))
    return out.select("lecture_id", "sequence", "start_seconds", "end_seconds", "raw_text", "text", "reason", F.when(F.col("reason") != "non_speech", F.col("n_collapsed")).otherwise(0).alias("n_collapsed"))


def cleaning_counts(cleaned: DataFrame) -> DataFrame:
    changed = (F.col("reason") == "kept") & (F.col("text") != F.regexp_replace("raw_text", r"(?U)^\s+|\s+$", ""))
    return cleaned.groupBy("lecture_id").agg(
        F.count("*").alias("n_segments"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("kept", "duplicate", "non_speech", "empty")],
        F.sum("n_collapsed").alias("n_collapsed"),
        F.count_if(changed).alias("n_changed"),
    )
