"""Exact vector search with guards, candidate cut, threshold and caps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.text import cut_text
from marlpit.functions.vector import norm
from marlpit.schema import ANSWER_MOST, INSUFFICIENT, LIBRARY_CANDIDATES, MIN_SIMILARITY, SEARCH_LIMIT, SEARCH_PER_LECTURE

#: Chunks and queries of a pair of blocks that are multiplied, and queries of these taken at once.
CHUNK_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 4096, 256
#: What the sum of a product may differ by from the exact similarity, and lengths between which that holds.
SLACK, SHORT, LONG = 1e-9, 1e-100, 1e100
#: No query gets more chunks than this from one lecture, or from the library.
LECTURE_MOST, LIBRARY_MOST = 50, 100


def shown() -> Column:
    return F.round("similarity", 4).alias("similarity")


def similarities(queries: DataFrame, chunks: DataFrame, top: int, own_lecture: bool = False) -> DataFrame:
    """Every query's `top` most similar chunks of the same model and length, by exact similarity; ties go to the smaller sequence.
    Vectors that are null, zero or not finite are similar to nothing.

    Ranks, thresholds and budgets look at the exact value; shown() rounds it for output. top is held between 1 and the most
    that its kind of search gives: LECTURE_MOST chunks of one lecture, LIBRARY_MOST of all.

    Chunks and queries (query_id, query_model, query) are dealt to blocks, and every block of queries meets every block of
    chunks in a task that multiplies them and sends on `top` for each query: no pair is a row, no vector is broadcast.

    own_lecture: only chunks of the query's lecture, query_lecture. A lecture has its own blocks, as many as its size asks
    for; small lectures share them."""
    top = min(max(top, 1), LECTURE_MOST if own_lecture else LIBRARY_MOST)
    q = queries.withColumn("query_norm", norm(F.col("query")))
    c = chunks.where("embedding is not null").withColumn("chunk_norm", norm(F.col("embedding")))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sequence", "chunk_id")
    near = _nearest_of_blocks(c, q, top, own_lecture)
    return near.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)


def _dealt_by_lecture(c: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with __home, __blocks and __parts: a lecture of more than one block is a home of its own, others share
    homes of about a block. Only lectures of more than one block are broadcast, of which there are no more than blocks."""
    sizes = c.groupBy("lecture_id").agg(F.count("*").alias("n")).join(q.groupBy(F.col("query_lecture").alias("lecture_id")).agg(F.count("*").alias("asked")), "lecture_id", "full_outer")
    sizes = sizes.select("lecture_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n", "asked")])
    large = (F.col("n") > CHUNK_BLOCK) | (F.col("asked") > QUERY_BLOCK)
    n, asked = sizes.where(~large).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    homes = max(1, -(-n // CHUNK_BLOCK), -(-asked // QUERY_BLOCK))
    own = sizes.where(large).select("lecture_id", F.ceil(F.col("n") / CHUNK_BLOCK).alias("__blocks"), F.ceil(F.col("asked") / QUERY_BLOCK).alias("__parts"))

    def dealt(side: DataFrame, lecture: str) -> DataFrame:
        met = side.join(F.broadcast(own.withColumnRenamed("lecture_id", lecture)), lecture, "left")
        home = F.when(F.col("__blocks").isNull(), F.concat(F.lit("home "), F.pmod(F.xxhash64(F.col(lecture).cast("long")), F.lit(homes)))).otherwise(F.concat(F.lit("lecture "), lecture))
        met = met.withColumn("__home", home).withColumns({n: F.coalesce(n, F.lit(1)) for n in ("__blocks", "__parts")})
        return met.where("__blocks > 0 and __parts > 0")

    return dealt(c, "lecture_id"), dealt(q, "query_lecture")


def _nearest_of_blocks(c: DataFrame, q: DataFrame, top: int, own_lecture: bool) -> DataFrame:
    """For each query and block of chunks the `top` most similar: the columns of both sides but for vectors, and similarity."""
    shown_c, shown_q = [n for n in c.columns if n not in ("embedding", "chunk_norm")], [n for n in q.columns if n not in ("query", "query_norm", "query_model")]
    if own_lecture:
        c, q = c.where("lecture_id is not null"), q.where("query_lecture is not null")
    c, q = (side.where((F.col(n) > 0) & ~F.isnan(n)) for side, n in ((c.where("embedding_model is not null"), "chunk_norm"), (q.where("query_model is not null"), "query_norm")))
    if own_lecture:
        left, right = _dealt_by_lecture(c, q)
    else:
        blocks, parts = (max(1, -(-side.count() // size)) for side, size in ((c, CHUNK_BLOCK), (q, QUERY_BLOCK)))
        left, right = (side.withColumns({"__home": F.lit(""), "__blocks": F.lit(blocks), "__parts": F.lit(parts)}) for side in (c, q))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    dealt = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = left.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("__block", dealt("chunk_id", "__blocks")).withColumn("__part", every("__parts"))
    right = right.withColumn("query", F.col("query").cast("array<double>")).withColumn("__part", dealt("query_id", "__parts")).withColumn("__block", every("__blocks"))
    schema = T.StructType([*c.select(*shown_c).schema.fields, *q.select(*shown_q).schema.fields, T.StructField("similarity", T.DoubleType())])

    def kinds(table: pa.Table, labels: list[str], vectors: pa.ChunkedArray) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        """Of each model, length, and lecture where only its own counts, the places and the vectors."""
        at: dict[tuple, list[int]] = {}
        for i, kind in enumerate(zip(*(table[n].to_pylist() for n in labels[: 1 + own_lecture]), pc.list_value_length(vectors).to_pylist())):
            at.setdefault(kind, []).append(i)
        return {k: (np.array(i), vectors.take(pa.array(i)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(i), k[-1])) for k, i in at.items()}

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        asked = kinds(queries, ["query_model", "query_lecture"], queries["query"])
        for kind, (of_c, x) in kinds(chunks, ["embedding_model", "lecture_id"], chunks["embedding"]).items():
            if kind not in asked:
                continue
            of_q, y = asked[kind]
            norm_x, norm_y = chunks["chunk_norm"].to_numpy()[of_c], queries["query_norm"].to_numpy()[of_q]
            odd_x, odd_y = (~((v > SHORT) & (v < LONG)) for v in (norm_x, norm_y))
            by_place = np.ascontiguousarray(x.T)
            for lo in range(0, len(y), AT_ONCE):
                some, length = y[lo : lo + AT_ONCE], norm_y[lo : lo + AT_ONCE]
                with np.errstate(all="ignore"):
                    near = some @ by_place / (length[:, None] * norm_x)
                    odd = ~np.isfinite(near) | odd_x | odd_y[lo : lo + AT_ONCE, None]
                    near[odd] = -np.inf
                    if len(x) > top:
                        # What may be among the first, or isn't computed well by a product, is computed exactly.
                        least = np.partition(near, len(x) - top, axis=1)[:, len(x) - top, None]
                        of, at = np.nonzero((near >= least - SLACK) | odd)
                    else:
                        of, at = (a.ravel() for a in np.indices(near.shape))
                    sums = np.zeros(len(of))
                    for place, own in zip(by_place, np.ascontiguousarray(some.T)):
                        sums += place[at] * own[of]
                    similarity = sums / (norm_x[at] * length[of])
                    good = (norm_x[at] * length[of] != 0) & ~np.isnan(similarity)
                of, at, similarity = of[good], at[good], similarity[good]
                rows = chunks.select(shown_c).take(pa.array(of_c[at]))
                order = pc.sort_indices(
                    pa.table({"of": of, "similarity": similarity, "sequence": rows["sequence"], "chunk_id": rows["chunk_id"]}),
                    sort_keys=[("of", "ascending"), ("similarity", "descending"), ("sequence", "ascending"), ("chunk_id", "ascending")], null_placement="at_start",
                ).to_numpy()
                of = of[order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                nth = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
                order, of = order[nth < top], of[nth < top]
                mine = queries.select(shown_q).take(pa.array(of_q[lo + of]))
                found.append(pa.table([*rows.take(pa.array(order)).columns, *mine.columns, pa.array(similarity[order])], names=schema.names))
        if found:
            return pa.concat_tables(found)
        return pa.table([*chunks.select(shown_c).slice(0, 0).columns, *queries.select(shown_q).slice(0, 0).columns, pa.array([], pa.float64())], names=schema.names)

    keys = ["__home", "__block", "__part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def search_content(queries: DataFrame, chunks: DataFrame, lectures: DataFrame, candidates: int = LIBRARY_CANDIDATES, threshold: float = MIN_SIMILARITY, per_lecture: int = SEARCH_PER_LECTURE, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Candidates first, then the threshold, then the cap for each lecture, then the limit: a lecture may crowd out others among the candidates."""
    ready = lectures.where("status = 'READY'").select("lecture_id", "title", "user_id")
    near = similarities(queries, chunks.join(ready, "lecture_id"), candidates).where(F.col("similarity") >= threshold)
    order = [F.desc("similarity"), F.col("sequence"), F.col("chunk_id")]
    capped = near.withColumn("in_lecture", F.row_number().over(Window.partitionBy("query_id", "lecture_id").orderBy(*order))).where(F.col("in_lecture") <= per_lecture)
    return capped.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("place") <= limit)


def evidence(ranked: DataFrame, threshold: float, budget: int) -> DataFrame:
    """Best first while token_estimate fits the budget, the first always; then numbered by sequence."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sequence", "chunk_id")
    kept = ranked.where(F.col("similarity") >= threshold)
    kept = kept.withColumn("used", F.sum("token_estimate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("nth", F.row_number().over(order))
    kept = kept.where((F.col("used") <= budget) | (F.col("nth") == 1))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("sequence", "chunk_id")).cast("long"))


def interpret(answers: DataFrame, n_passages: Column, use_answerable: bool = True, require_citations: bool = True) -> DataFrame:
    """answers (answerable, citations, answer: strings as the model gave them) with outcome, decision, cited and shown_answer.

    An answer that is blank, or not marked answerable, is declined; one that cites no passage given is refused; both show
    no answer and no citation. White space is squeezed and the answer cut. The two switches turn the last two rules off."""
    text = cut_text(F.col("answer"), ANSWER_MOST)
    cited = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda c: F.trim(c).try_cast("int")), lambda c: c.between(1, n_passages))))
    declined = text == ""
    if use_answerable:
        declined = declined | ~F.coalesce(F.col("answerable") == "true", F.lit(False))
    decision = F.when(declined, "model_declined").otherwise("answered")
    if require_citations:
        decision = F.when(declined, "model_declined").when(F.size(cited) == 0, "no_valid_citations").otherwise("answered")
    out = answers.withColumn("decision", decision)
    good = F.col("decision") == "answered"
    return out.withColumns({"outcome": F.when(good, "answered").otherwise(INSUFFICIENT), "cited": F.when(good, cited).otherwise(F.array().cast("array<int>")), "shown_answer": F.when(good, text)})


def index_report(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.groupBy("lecture_id").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("embedding").isNull()).alias("n_missing"),
        F.count_if(F.col("embedding_model") != model).alias("n_other_model"),
    )


def probes(chunks: DataFrame) -> DataFrame:
    """The first, middle and last chunk of every lecture: each must find itself."""
    order = chunks.withColumn("nth", F.row_number().over(Window.partitionBy("lecture_id").orderBy("sequence", "chunk_id")) - 1)
    sizes = chunks.groupBy("lecture_id").agg(F.count("*").alias("n"))
    return order.join(sizes, "lecture_id").where("nth = 0 or nth = n div 2 or nth = n - 1")
