"""Sentence-aware chunks with overlap, and packing into windows.

Where a chunk ends depends on where the last one did, so a lecture's segments are folded in order, carrying two numbers;
overlap, the short tail and the texts follow from group numbers by windows and aggregates. The fold takes (sequence,
cost, closes) of a lecture, never its texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions import text as tx
from marlpit.schema import CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP, LLM_WINDOW


def _groups(rows: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """rows (key, sequence, cost, closes) -> (key, sequence, grp, fresh): fresh is the cost counted in the last group so far.

    A lecture's rows lie in one partition, in order, and stream past two numbers: no lecture is ever held whole."""
    out = T.StructType([rows.schema[key], T.StructField("sequence", T.LongType()), T.StructField("grp", T.IntegerType()), T.StructField("fresh", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh, grp = None, 0, -1
        for batch in batches:
            groups, counted = [], []
            for lecture, cost, closes in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if grp < 0 or lecture != now:
                    now, fresh, grp = lecture, 0, 0
                elif fresh >= low and fresh + cost > high:
                    fresh, grp = 0, grp + 1
                fresh += cost
                groups.append(grp)
                counted.append(fresh)
                if closes and fresh >= low:
                    fresh, grp = 0, grp + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(groups, pa.int32()), pa.array(counted, pa.int64())], names=out.names)

    narrow = rows.select(key, F.col("sequence").cast("long").alias("sequence"), F.col("cost").cast("long").alias("cost"), "closes")
    return narrow.repartition(key).sortWithinPartitions(key, "sequence", "cost", "closes").mapInArrow(run, out)


def build_chunks(segments: DataFrame, low: int = CHUNK_MIN, high: int = CHUNK_MAX, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """segments (lecture_id, sequence, start_seconds, end_seconds, text) -> one row for each chunk."""
    if not 0 <= overlap < low <= high:
        raise ValueError("0 <= overlap < min <= max doesn't hold")
    full = segments.where(F.trim("text") != "").withColumn("cost", tx.estimate_tokens(F.col("text")))
    placed = _groups(full.select("lecture_id", "sequence", "cost", tx.ends_sentence(F.col("text")).alias("closes")), "lecture_id", low, high)
    # A last group below half of the minimum goes to the one before it.
    ends = placed.groupBy("lecture_id").agg(F.max(F.struct("sequence", "grp", "fresh")).alias("last"))
    placed = placed.join(ends, "lecture_id")
    short = (F.col("grp") == F.col("last.grp")) & (F.col("grp") > 0) & (F.col("last.fresh") * 2 < low)
    placed = placed.withColumn("merged", short).withColumn("grp", F.when(short, F.col("grp") - 1).otherwise(F.col("grp"))).drop("last", "fresh")
    body = full.join(placed, ["lecture_id", "sequence"])
    # The overlap is the end of the group before, as it was before any merge; only the last group can have grown.
    back = Window.partitionBy("lecture_id", "grp").orderBy(F.desc("sequence")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = body.where("not merged").withColumn("from_end", F.sum("cost").over(back)).where(F.col("from_end") <= overlap)
    groups = body.select("lecture_id", "grp").distinct()
    tail = tail.withColumn("grp", F.col("grp") + 1).join(groups, ["lecture_id", "grp"], "left_semi")
    columns = ["lecture_id", "grp", "sequence", "start_seconds", "end_seconds", "text"]
    every = body.select(*columns).union(tail.select(*columns))
    chunks = every.groupBy("lecture_id", "grp").agg(
        F.sort_array(F.collect_list(F.struct("sequence", "text"))).alias("parts"),
        F.min("sequence").alias("first_segment"),
        F.max("sequence").alias("last_segment"),
        F.min_by("start_seconds", "sequence").alias("start_seconds"),
        F.max_by("end_seconds", "sequence").alias("end_seconds"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return chunks.select("lecture_id", F.col("grp").cast("long").alias("chunk"), text.alias("text"), "start_seconds", "end_seconds", "first_segment", "last_segment", tx.estimate_tokens(text).cast("long").alias("token_estimate"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("lecture_id").agg(
        F.count("*").alias("n_chunks"), F.min("token_estimate").alias("min_tokens"), F.median("token_estimate").alias("median_tokens"), F.max("token_estimate").alias("max_tokens")
    )


def llm_windows(chunks: DataFrame, budget: int = LLM_WINDOW, overhead: int = 12) -> DataFrame:
    """Chunks packed in order into windows of at most budget tokens, each chunk costing overhead more; a larger chunk stands alone."""
    rows = chunks.select("lecture_id", F.col("chunk").alias("sequence"), (F.col("token_estimate") + overhead).cast("int").alias("cost"), F.lit(False).alias("closes"))
    placed = _groups(rows, "lecture_id", 1, budget)
    sized = placed.join(rows, ["lecture_id", "sequence"])
    return sized.groupBy("lecture_id", F.col("grp").cast("long").alias("window")).agg(F.count("*").alias("n_chunks"), F.sum("cost").alias("cost"), F.min("sequence").alias("first_chunk"))
