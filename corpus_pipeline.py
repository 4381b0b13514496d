"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns documents for the next one; all but the last return the columns of
docs. run() writes each stage's rows to the shared folder and reads them again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit import ship
from marlpit.llm import bpe, line_dedup, minhash, mixing, quality
from marlpit.llm.common import Scratch, read_table, where_computed


def _with_text(out: DataFrame, text, columns: list[str]) -> DataFrame:
    """Documents with a new text, and n_chars after it where there is one."""
    out = out.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return _with_text(where_computed(quality.quality_rules(docs), "kept"), F.col("clean_text"), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their last holder keeps for them; documents left without text go."""
    ship(spark)
    out = _with_text(line_dedup.dedup_lines(docs), F.col("text"), docs.columns)
    return out.where(F.btrim("text", F.lit(quality.SPACES)) != "")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id in every group."""
    ship(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian) and whether decoding gives the text back."""
    ship(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.encode(docs.select("doc_id", "text"), ranks, pattern, offsets=False, decoded="decoded")
    return back.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing to weights", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Weighted MinHash and merging by ranks aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(docs)
        docs = new
    return docs
