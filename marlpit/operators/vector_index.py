"""A kept inverted-file index of chunk vectors: candidates from the nearest cells, ranked by their exact similarity.

Vectors of one model and length are dealt to the nearest of `lists` centroids, which spherical k-means finds on a bounded
sample. A cell's vectors are packed into blocks of about BLOCK rows, so a cell of any size is many rows; files are
partitioned by cell. A search sends each query to its `probes` nearest cells, packs the queries of a cell as well, and
multiplies block with block, so no pair of a query and a chunk is a row; a block sends on `top` chunks a query, and the
exact similarity of these, in the same arithmetic as the search without an index, gives the ranks. With as many probes as
lists the result is that of the exact search. `calibrate` measures recall against it and picks the probes.

Vectors that are null, zero or hold null or non-finite components, or have no model, aren't indexed: they are similar to
nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.functions.vector import cosine, norm
from marlpit.operators.retrieval import LIBRARY_MOST, similarities

#: Rows of a block of vectors or of queries.
BLOCK, QUERY_ROWS = 2048, 512
#: Lists of a model at most, sampled vectors for each, in all at most, and rounds of k-means.
MOST_LISTS, SAMPLE_EACH, SAMPLE_MOST, ROUNDS = 1024, 48, 40_000, 12
#: Queries that calibrate() measures recall on.
CALIBRATION_QUERIES = 200
#: What the sum of a product may differ by from the exact similarity.
SLACK = 1e-9


def _usable(chunks: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return chunks.where(F.col("embedding_model").isNotNull() & F.coalesce(finite & (norm(F.col("embedding")) > 0), F.lit(False)))


def _k_means(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of unit vectors on the sphere. An empty cell takes the vector that is farthest from its centre."""
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        cell, closeness = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1)
        for k in np.flatnonzero(length == 0):
            far = closeness.argmin()
            sums[k], length[k], closeness[far] = sample[far], 1.0, 2.0
        centres = sums / length[:, None]
    return centres


class VectorIndex:
    """An index in `folder`: tables `cells` (model, dim, cell, centre) and `blocks` (cell, block, dim, rows, matrix)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.centres: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        found: dict[tuple[str, int], list] = {}
        for r in spark.read.parquet(f"{folder}/cells").collect():  # MOST_LISTS rows a model
            found.setdefault((r.model, r.dim), []).append((r.cell, r.centre))
        for key, rows in found.items():
            rows.sort()
            self.centres[key] = np.array([c for c, _ in rows]), np.array([v for _, v in rows])

    @property
    def lists(self) -> int:
        """The most lists that a model has."""
        return max((len(cells) for cells, _ in self.centres.values()), default=0)

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, lists: int | None = None, seed: int = 7) -> VectorIndex:
        """Indexes chunks (chunk_id, embedding_model, embedding, and any more columns, which a search gives back).

        lists: for each model and length; the square root of their number if not given, MOST_LISTS at most."""
        spark = chunks.sparkSession
        good = _usable(chunks)
        kinds = good.groupBy("embedding_model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()
        rng, cells, first = np.random.default_rng(seed), [], 0
        centres: dict[tuple[str, int], np.ndarray] = {}
        for kind in sorted(kinds, key=lambda k: (k.embedding_model, k.dim)):
            own = good.where((F.col("embedding_model") == kind.embedding_model) & (F.size("embedding") == kind.dim))
            wanted = min(lists or math.isqrt(kind.n), MOST_LISTS)
            share = own.select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(min(SAMPLE_MOST, SAMPLE_EACH * wanted))
            sample = np.array([r.embedding for r in share.toLocalIterator()], dtype=np.float64)
            sample /= np.linalg.norm(sample, axis=1)[:, None]
            made = _k_means(sample, max(1, min(wanted, len(sample))), rng)
            centres[kind.embedding_model, kind.dim] = made
            cells += [(kind.embedding_model, kind.dim, first + k, v.tolist()) for k, v in enumerate(made)]
            first += len(made)
        spark.createDataFrame(cells, "model string, dim int, cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")
        index = cls(spark, folder)
        payload = T.StructType([f for f in chunks.schema.fields if f.name != "embedding"])
        row = F.struct(*payload.names)
        placed = index._nearest(good.select("embedding_model", row.alias("row"), "embedding", F.xxhash64("chunk_id").alias("h")), 1, ["row", "h"])
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        # Few numbers a cell; they are joined, not collected.
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod("h", F.ceil(F.col("n") / BLOCK)).cast("int"))

        def pack(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            matrix = np.array(table["embedding"].to_pylist(), dtype="<f8")
            rows = pa.ListArray.from_arrays(pa.array([0, len(matrix)], pa.int32()), table["row"].combine_chunks())
            return pa.Table.from_arrays([table["cell"].slice(0, 1), table["block"].slice(0, 1), pa.array([matrix.shape[1]], pa.int32()), rows, pa.array([matrix.tobytes()], pa.binary())], names=["cell", "block", "dim", "rows", "matrix"])

        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("rows", T.ArrayType(payload)), T.StructField("matrix", T.BinaryType())])
        spark.createDataFrame([], schema).write.parquet(f"{folder}/schema")  # an empty index has no other file that tells it
        packed = dealt.select("cell", "block", "row", "embedding").groupBy("cell", "block").applyInArrow(pack, schema)
        packed.repartition("cell").write.partitionBy("cell").parquet(f"{folder}/blocks")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/schema").schema).parquet(f"{self.folder}/blocks")

    def _nearest(self, rows: DataFrame, probes: int, keep: list[str]) -> DataFrame:
        """rows (embedding_model, embedding, ...) with each of their nearest cells, of those of their model and length, and its place from 0."""
        centres, fields = self.centres, rows.select(*keep, "embedding").schema.fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
                models, lists = part.column("embedding_model").to_pylist(), part.column("embedding")
                lengths = np.asarray(lists.value_lengths())
                by_kind: dict[tuple, list[int]] = {}
                for i, (m, d) in enumerate(zip(models, lengths.tolist())):
                    if (m, d) in centres:
                        by_kind.setdefault((m, d), []).append(i)
                for key, at in by_kind.items():
                    cells, middle = centres[key]
                    near = np.asarray(lists.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, key[1]) @ middle.T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                    chosen = part.select([*keep, "embedding"]).take(pa.array(np.repeat(at, best.shape[1])))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cells[best.ravel()].astype(np.int32)), pa.array(np.tile(np.arange(best.shape[1], dtype=np.int32), len(at)))], names=[*keep, "embedding", "cell", "nth"])

        return rows.select("embedding_model", "embedding", *keep).mapInArrow(run, T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("nth", T.IntegerType())]))

    def search(self, queries: DataFrame, top: int, probes: int, lectures: DataFrame | None = None) -> DataFrame:
        """The `top` nearest chunks that the probed cells hold, for queries (query_id, query_model, query): query_id, the chunks'
        columns, similarity, rank. lectures: only chunks of these lecture_ids count, before any rank is given."""
        top = min(max(top, 1), LIBRARY_MOST)
        asked = self._nearest(_usable(queries.select("query_id", F.col("query_model").alias("embedding_model"), F.col("query").alias("embedding"))), probes, ["query_id"])
        in_cell = asked.groupBy("cell").agg(F.count("*").alias("n"))
        asked = asked.join(in_cell, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / QUERY_ROWS)))
        packed = asked.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "embedding")).alias("queries"))
        blocks = self.blocks()
        if lectures is not None:
            # Ids alone are joined; of a block only the places of chunks that count go on.
            places = blocks.select("cell", "block", F.posexplode("rows.lecture_id").alias("place", "lecture_id")).join(lectures.select("lecture_id").distinct(), "lecture_id")
            blocks = blocks.join(places.groupBy("cell", "block").agg(F.sort_array(F.collect_list("place")).alias("places")), ["cell", "block"])
        else:
            blocks = blocks.withColumn("places", F.lit(None).cast("array<int>"))
        met = blocks.join(packed, "cell").select("dim", "rows", "matrix", "places", "queries")
        kind = asked.schema["query_id"].dataType
        payload = blocks.schema["rows"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", kind), T.StructField("row", payload), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("query", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    dim, rows, some = batch.column(0)[k].as_py(), batch.column(1)[k].values, batch.column(3)[k].values
                    x, asked_ = np.frombuffer(batch.column(2)[k].as_buffer(), "<f8").reshape(-1, dim), batch.column(4)[k].values
                    if some is not None:
                        rows, x = rows.take(some), x[np.asarray(some)]
                    vectors = asked_.field(1)
                    q = np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, dim)
                    near = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
                    if near.shape[1] > top:
                        least = -np.partition(-near, top - 1, axis=1)[:, top - 1 : top]
                        of, at = np.nonzero(near >= least - SLACK)  # what ties with the last goes on too
                    else:
                        of, at = (a.ravel() for a in np.indices(near.shape))
                    found = pa.array(x[at].ravel())
                    found = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * dim + 1, dim), pa.int32()), found)
                    yield pa.RecordBatch.from_arrays([asked_.field(0).take(pa.array(of)), rows.take(pa.array(at)), found, vectors.take(pa.array(of))], names=schema.names)

        near = met.mapInArrow(run, schema).withColumn("similarity", cosine(F.col("embedding"), F.col("query"), norm(F.col("embedding")), norm(F.col("query"))))
        flat = near.select("query_id", "row.*", "similarity")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sequence", "chunk_id")
        return flat.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)

    def recall(self, queries: DataFrame, chunks: DataFrame, top: int, probes: list[int]) -> dict[int, float]:
        """For each number of probes, the share of the exact search's chunks that the index finds too. A search gives every one of
        them whose cell it probes, as fewer chunks compete there, so the place of its cell among the query's tells from which
        number on, and no search is run."""
        exact = similarities(queries, chunks, top).select("query_id", "chunk_id")
        cells = self.blocks().select("cell", F.explode("rows.chunk_id").alias("chunk_id"))
        asked = _usable(queries.select("query_id", F.col("query_model").alias("embedding_model"), F.col("query").alias("embedding")))
        near = self._nearest(asked, max(probes), ["query_id"]).select("query_id", "cell", "nth")
        at = exact.join(cells, "chunk_id").join(near, ["query_id", "cell"]).groupBy("query_id", "chunk_id").agg(F.min("nth").alias("nth"))
        found = exact.join(at, ["query_id", "chunk_id"], "left")
        row = found.agg(F.count("*").alias("n"), *[F.count_if(F.col("nth") < p).alias(f"p{p}") for p in probes]).first()
        return {p: row[f"p{p}"] / row.n for p in probes} if row.n else {}

    def calibrate(self, queries: DataFrame, chunks: DataFrame, top: int, target: float = 0.9) -> tuple[int, float]:
        """The least number of probes, of 1, 2, 3, 4, 6, 8, 12 ... and all lists, whose recall on at most CALIBRATION_QUERIES queries (of
        lowest hash) is target or more, and that recall."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES)
        every = max(self.lists, 1)
        steps = sorted({every} | {m * 2**k for m in (1, 3) for k in range(every.bit_length()) if m * 2**k < every})
        measured = self.recall(some, chunks, top, steps)
        return next(((p, measured[p]) for p in steps if measured.get(p, 1.0) >= target), (steps[-1], 1.0))
