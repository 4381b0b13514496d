"""Sharding by global prefix sums of byte sizes: contiguous shards of nearly equal bytes.

Documents are put in order of doc_id and cut into ranges; the totals of the ranges give every range its offset, and a
running sum inside the range gives each document its place. Only ids, sizes and checksums are shuffled, never texts.

Defined results for odd input: a null text has size 1 and checksum 0; a null doc_id sorts first; repeated rows take
places of their own, in order of size and checksum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import shuffle_width, text_or_empty


def order_ranges(df: DataFrame, key: str, n_ranges: int) -> DataFrame:
    """df with `range`, an int growing with key, of about equally many rows each.

    The bounds are at most n_ranges - 1 quantiles, in one row that is joined to all others."""
    steps = [i / n_ranges for i in range(1, n_ranges)]
    bounds = df.agg(F.coalesce(F.percentile_approx(key, steps, 10 * n_ranges), F.array().cast("array<bigint>")).alias("__bounds"))
    bounds = bounds.select(F.array_distinct("__bounds").alias("__bounds"))
    # The number of bounds below the key, by halving: a bound of n_ranges elements needs few looks.
    out = df.crossJoin(F.broadcast(bounds)).withColumn("range", F.lit(0))
    step = 1 << n_ranges.bit_length()
    while step:
        further = F.col("range") + step
        out = out.withColumn("range", F.when(F.coalesce(F.get("__bounds", further - 1) < F.col(key), F.lit(False)), further).otherwise(F.col("range")))
        step >>= 1
    return out.drop("__bounds")


def range_offsets(ranged: DataFrame, **totals: str) -> DataFrame:
    """(range, one offset column for each total): what all ranges before hold. There are few ranges, so one task sums them."""
    sums = ranged.groupBy("range").agg(*[F.sum(c).alias(name) for name, c in totals.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in totals])


def balanced_shards(docs: DataFrame, n_shards: int = 16, n_ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    A document belongs to the shard in which the sum of the sizes before it falls; slot counts from 0 in every shard."""
    spark = docs.sparkSession
    ranges = n_ranges or min(1000, max(64, 4 * shuffle_width(spark)))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"),
    ).withColumn("one", F.lit(1).cast("long"))
    ranged = order_ranges(rows, "doc_id", ranges)
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.agg(F.sum("size").alias("total"))
    placed = (
        ranged.withColumn("sum_in", F.sum("size").over(inside) - F.col("size"))
        .withColumn("rank_in", F.sum("one").over(inside) - 1)
        .join(F.broadcast(range_offsets(ranged, bytes_before="size", rows_before="one")), "range")
        .crossJoin(F.broadcast(total))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(bytes_before + sum_in) * {n_shards} div total")).cast("int"))
        .withColumn("rank", F.col("rows_before") + F.col("rank_in"))
    )
    # A shard begins in one range: its first rank is the least over at most n_shards x ranges pre-aggregated rows.
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
