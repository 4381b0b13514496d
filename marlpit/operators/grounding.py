"""Grounding of generated items in their transcript, chapters, carry-over. Items are rows; caps are row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.text import cut_text, squeeze
from marlpit.schema import ITEM_LIMITS, SUMMARY_LEAST, SUMMARY_MOST, TEXT_LIMITS


def references(raw: Column, n_chunks: Column) -> Column:
    """Integers among raw strings that name a chunk, distinct and sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda x: x.between(0, n_chunks - 1))))


def ground_items(items: DataFrame, lectures: DataFrame) -> DataFrame:
    """items (lecture_id, kind, position, term, raw_refs), lectures (lecture_id, n_chunks, text): items that stay, capped by kind.

    Terms are squeezed and cut to their kind's limit; without a term an item goes, and without a valid reference, but for
    keywords, which need none. Definitions are capped before their term is looked for in the text, keywords after, and
    keywords are unique but for case. A term is looked for once in a lecture, and no text goes through a window."""
    limit = F.create_map(*[x for k, v in TEXT_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    cut = items.withColumn("term", F.substring(squeeze(F.coalesce("term", F.lit(""))), F.lit(1), limit[F.col("kind")])).where("term <> ''").withColumn("low", F.lower("term"))
    texts = lectures.select("lecture_id", "n_chunks", F.lower("text").alias("text"))
    # Contained in the text: a condition of the join, so that no row carries a text on.
    said = F.contains("text", F.col("low"))
    order = Window.partitionBy("lecture_id", "kind").orderBy("position")
    cap = F.create_map(*[x for k, v in ITEM_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    met = cut.where("kind <> 'keywords'").join(lectures.select("lecture_id", "n_chunks"), "lecture_id").withColumn("refs", references(F.col("raw_refs"), F.col("n_chunks")))
    others = met.where(F.size("refs") > 0).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap[F.col("kind")])
    others = others.drop("n_chunks").join(texts, "lecture_id").where((F.col("kind") != "definitions") | said)
    # Whether a keyword is found goes by its letters alone, so the first of each is picked before.
    words = cut.where("kind = 'keywords'").groupBy("lecture_id", "low").agg(F.min(F.struct("position", "term", "raw_refs")).alias("first"))
    words = words.join(texts, "lecture_id").where(said).select("lecture_id", F.lit("keywords").alias("kind"), "first.*", "n_chunks")
    words = words.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ITEM_LIMITS["keywords"]).withColumn("refs", references(F.col("raw_refs"), F.col("n_chunks")))
    kept = ["lecture_id", "kind", "position", "term", "refs"]
    return others.select(kept).union(words.select(kept))


def summaries(generated: DataFrame) -> DataFrame:
    """generated (lecture_id, summary) with the summary cut; those too short are dropped, as their whole result is refused."""
    s = F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?U)^\s+|\s+$", "")
    return generated.withColumn("summary", s).where(F.length("summary") >= SUMMARY_LEAST).withColumn("summary", F.substring("summary", 1, SUMMARY_MOST))


def dropped_counts(items: DataFrame, kept: DataFrame) -> DataFrame:
    """(lecture_id, kind, n_dropped, n_kept): what grounding dropped, by position of each kind."""
    here = kept.select("lecture_id", "kind", "position", F.lit(1).alias("stays"))
    return items.join(here, ["lecture_id", "kind", "position"], "left").groupBy("lecture_id", "kind").agg(F.count_if(F.col("stays").isNull()).alias("n_dropped"), F.count("stays").alias("n_kept"))


def chapters(proposed: DataFrame, chunks: DataFrame, clean_titles: bool = True) -> DataFrame:
    """proposed (lecture_id, start_chunk, title), chunks (lecture_id, chunk, start_seconds, end_seconds): at most 15 chapters.

    Proposals without a title, or whose start is no chunk, go first. Of those with one start the least title wins; the first
    kept chapter begins with the first chunk; each ends with the chunk before the next one's start, the last with the last.

    Titles are squeezed and cut. With clean_titles off they stay as proposed, and a start goes if its least title is blank."""
    by_chunk = Window.partitionBy("lecture_id").orderBy("chunk")
    placed = chunks.select("lecture_id", "chunk", F.lag("chunk").over(by_chunk).alias("previous"))
    bounds = chunks.groupBy("lecture_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("final"))
    titled = proposed.withColumn("title", cut_text(F.col("title"), TEXT_LIMITS["chapters"])).where("title <> ''") if clean_titles else proposed
    one = titled.groupBy("lecture_id", "start_chunk").agg(F.min("title").alias("title")).where(F.col("title").rlike(r"[^\p{Zs}]"))
    one = one.join(placed.withColumnRenamed("chunk", "start_chunk"), ["lecture_id", "start_chunk"])
    order = Window.partitionBy("lecture_id").orderBy("start_chunk")
    kept = one.withColumn("chapter", (F.row_number().over(order) - 1).cast("long")).where(F.col("chapter") < ITEM_LIMITS["chapters"])
    kept = kept.withColumn("before_next", F.lead("previous").over(order)).join(bounds, "lecture_id")
    kept = kept.select("lecture_id", "chapter", "title", F.when(F.col("chapter") == 0, F.col("first")).otherwise(F.col("start_chunk")).alias("first_chunk"), F.coalesce("before_next", "final").alias("last_chunk"))
    s = chunks.select("lecture_id", F.col("chunk").alias("first_chunk"), "start_seconds")
    e = chunks.select("lecture_id", F.col("chunk").alias("last_chunk"), "end_seconds")
    return kept.join(s, ["lecture_id", "first_chunk"]).join(e, ["lecture_id", "last_chunk"])


def carry_over(items: DataFrame) -> DataFrame:
    """items (lecture_id, part, position, term): the first of each term but for case, in order of part."""
    first = Window.partitionBy("lecture_id", F.lower("term")).orderBy("part", "position")
    return items.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def citation_start(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs (item, lecture_id, refs): the earliest start of the cited chunks that exist; NULL if none does."""
    each = refs.select("item", "lecture_id", F.explode_outer("refs").alias("chunk"))
    return each.join(chunks.select("lecture_id", "chunk", "start_seconds"), ["lecture_id", "chunk"], "left").groupBy("item").agg(F.min("start_seconds").alias("start_seconds"))
