"""Experiments as rows: typed overrides of a whitelist, and a grid of configurations in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.operators.retrieval import similarities
from marlpit.schema import CONTEXT_TOKENS, MIN_SIMILARITY, RAG_TOP_K

#: The settings that an experiment may override, and their types.
OVERRIDABLE = {
    "rag_top_k": "int",
    "rag_min_similarity": "double",
    "rag_context_tokens": "int",
    "rag_max_output_tokens": "int",
    "llm_temperature": "double",
    "llm_model": "string",
    "llm_reasoning_effort": "string",
}
DEFAULTS = {"rag_top_k": RAG_TOP_K, "rag_min_similarity": MIN_SIMILARITY, "rag_context_tokens": CONTEXT_TOKENS}
SWITCHES = ("use_threshold", "use_answerable", "require_citations")


def typed_overrides(rows: DataFrame) -> DataFrame:
    """rows (config, key, raw: text) -> a row for each config with a column of its own type for every overridable key, NULL where it
    isn't overridden, and `refused`: the keys that may not be overridden or whose text isn't of their type. The last of
    a key given twice, by text, counts."""
    of_type = {k: F.trim("raw").try_cast(kind) for k, kind in OVERRIDABLE.items()}
    good = F.lit(False)
    for k, value in of_type.items():
        good = good | ((F.col("key") == k) & value.isNotNull())
    columns = [F.max(F.when(F.col("key") == k, value)).alias(k) for k, value in of_type.items()]
    refused = F.array_sort(F.array_distinct(F.collect_list(F.when(~F.coalesce(good, F.lit(False)), F.coalesce("key", F.lit("")))))).alias("refused")
    return rows.groupBy("config").agg(*columns, refused)


def grid(sweeps: DataFrame) -> DataFrame:
    """Configurations (with any of the overridable columns) times all settings of the three abstention switches; settings that
    are NULL take their defaults."""
    out = sweeps
    for name, default in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(default)) if name in sweeps.columns else F.lit(default))
    for s in SWITCHES:
        out = out.withColumn(s, F.explode(F.array(F.lit(True), F.lit(False))))
    return out


def run_grid(queries: DataFrame, chunks: DataFrame, tokens: DataFrame, answers: DataFrame, configs: DataFrame, most: int) -> DataFrame:
    """A row for each config and setting of the switches: questions, those with evidence, and the decisions.

    chunks are ranked once, for the largest rag_top_k (`most`); configs are few rows that go to every task, and their
    filters, budgets and switches are columns. tokens (chunk_id, token_estimate); answers (query_id, answerable, cited:
    numbers of passages, answer). A question without evidence is declined before any answer; with the threshold off,
    every ranked chunk is evidence."""
    settings = configs.select("config", "rag_top_k", "rag_min_similarity", "rag_context_tokens", *SWITCHES)
    ranked = similarities(queries, chunks, most).join(tokens, "chunk_id").select("query_id", "chunk_id", "sequence", "rank", "similarity", "token_estimate")
    met = ranked.join(F.broadcast(settings), (F.col("rank") <= F.col("rag_top_k")) & (~F.col("use_threshold") | (F.col("similarity") >= F.col("rag_min_similarity"))))
    key = ["config", *SWITCHES]
    order = Window.partitionBy(*key, "query_id").orderBy(F.desc("similarity"), "sequence", "chunk_id")
    used = F.sum("token_estimate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = met.withColumn("used", used).withColumn("nth", F.row_number().over(order)).where((F.col("used") <= F.col("rag_context_tokens")) | (F.col("nth") == 1))
    passages = kept.groupBy(*key, "query_id").agg(F.count("*").alias("n_passages"))
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(settings.select(*key)))
    out = every.join(passages, [*key, "query_id"], "left").join(answers.select("query_id", "answerable", "cited", "answer"), "query_id", "left")
    valid = F.exists(F.coalesce("cited", F.array().cast("array<int>")), lambda c: F.coalesce(c.between(1, F.col("n_passages")), F.lit(False)))
    decision = (
        F.when(F.col("n_passages").isNull(), "below_threshold")
        .when((F.coalesce(F.trim("answer"), F.lit("")) == "") | (F.col("use_answerable") & ~F.coalesce("answerable", F.lit(False))), "model_declined")
        .when(F.col("require_citations") & ~valid, "no_valid_citations")
        .otherwise("answered")
    )
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("answered", "below_threshold", "model_declined", "no_valid_citations")]
    return out.withColumn("decision", decision).groupBy(*key).agg(F.count("*").alias("n_questions"), F.coalesce(F.sum("n_passages"), F.lit(0)).alias("n_passages"), *counts)
