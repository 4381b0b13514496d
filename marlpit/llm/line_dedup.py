"""Line dedup with exact references and sharded cuckoo filters, both open to insertion and deletion.

References are rows (key, doc_id): one for every document that holds a long line. They are kept as a log of signed rows,
from which counts of documents, and the largest document, follow exactly, so deleting a document's references undoes
its insertion (LineIndex). Keys in enough documents are frequent; every shard of them has a cuckoo filter, from which a
key is taken out again when it stops being frequent; a filter that gets full is built anew from the shard's exact keys, and
all are dealt anew when shards get too large. An index can be saved and opened again.
The filters let the references of other lines go before these are joined to the exact counts; a false positive is
dropped by that join. A key is 128 bits of xxh3 of the trimmed, ASCII-lower-cased line.

Defined results for odd input: a null or empty text is one empty line; lines that only repeat inside one document stay;
rows that share a doc_id are one document to the counts; rows without a doc_id don't count as documents and lose all
frequent lines; an empty table gives no rows; other columns pass through, except those named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.llm.common import Scratch

MIN_CHARS, MIN_DOCS = 40, 5
SPACES = " \t\n\x0b\x0c\r"
SALTS = 16
SLICE = 512


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key's two buckets follow from each other, so a fingerprint can move."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def of_size(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros((buckets, cls.SLOTS), dtype=np.uint16))

    @classmethod
    def built_from(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        """As large as it must be: a filter that fills up is begun again at twice the size."""
        size = len(k1)
        while True:
            new = cls.of_size(size)
            if all(new.add(f, b) for f, b in zip(*map(np.ndarray.tolist, new._places(k1, k2)))):
                return new
            size = 2 * max(size, 1)

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (np.asarray(k2).view(np.uint64) >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        return mark, (np.asarray(k2).view(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark, bucket):
        return bucket ^ ((mark * 0x5BD1E995) & (len(self.table) - 1))

    def add(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(mark, bucket)):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        moved = []
        for kick in range(self.KICKS):
            slot = (kick * 7 + mark) % self.SLOTS
            moved.append((b, slot, int(self.table[b, slot])))
            mark, self.table[b, slot] = moved[-1][2], mark
            b = self._other(mark, b)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for b, slot, old in reversed(moved):
            self.table[b, slot] = old
        return False

    def discard(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(mark, bucket)):
            found = np.flatnonzero(self.table[b] == mark)
            if len(found):
                self.table[b, found[0]] = 0
                return True
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(k1, k2)
        return (self.table[bucket] == mark[:, None]).any(1) | (self.table[self._other(mark, bucket)] == mark[:, None]).any(1)


def _line_keys(texts: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines; how many each text has; which of them are long; and the 128-bit keys of the long ones, as two columns."""
    cut = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = cut.flatten()
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=SPACES))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).to_pylist()))
    return lines, pc.list_value_length(cut).to_numpy(zero_copy_only=False), long, np.frombuffer(digests, "<i8").reshape(-1, 2)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): one row for each document and long line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                _, per_doc, long, keys = _line_keys(part.column(1), min_chars)
                doc = np.repeat(np.arange(part.num_rows), per_doc)[long]
                if len(doc):
                    rows = np.unique(np.column_stack([doc, keys]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 2]), part.column(0).take(pa.array(rows[:, 0]))], names=["k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def delete(refs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """References without those of the documents whose doc_id is given."""
    return refs.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select("k1", "k2", "doc_id")


def _counts(held: DataFrame, *also) -> DataFrame:
    """held (k1, k2, doc_id, n: its references) -> n_docs and keep_doc, the largest of them, for every key."""
    there = F.when(F.col("n") > 0, F.col("doc_id"))
    return held.groupBy("k1", "k2").agg(F.count(there).alias("n_docs"), F.max(there).alias("keep_doc"), *also)


def frequent_keys(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, n_docs, keep_doc): exact counts of the keys in min_docs documents or more, and the largest of these."""
    held = refs.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"))
    return _counts(held).where(F.col("n_docs") >= min_docs)


class LineIndex:
    """The kept state of line dedup: a log of references (k1, k2, doc_id, delta, batch), the frequent keys' counts, and their filters.

    apply() takes one batch of inserted and deleted references. It appends signed rows to the log, takes exact counts of
    the touched keys alone from it, and moves keys in and out of the filters: after any batches the state is that of
    the documents left, as if these alone had been inserted. Every table lies in the shared folder."""

    def __init__(self, scratch: Scratch, min_docs: int = MIN_DOCS, keys_per_shard: int = 100_000) -> None:
        self.scratch, self.min_docs, self.keys_per_shard = scratch, min_docs, keys_per_shard
        self.batches, self.log, self.frequent, self.filters, self.shards = 0, [], None, None, 0

    def apply(self, come: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """come and gone: references (k1, k2, doc_id) of the documents inserted and deleted. All rows of a document go at once."""
        self.batches += 1
        signed = [r.select("k1", "k2", "doc_id", F.lit(d).cast("long").alias("delta"), F.lit(self.batches).alias("batch")) for r, d in ((come, 1), (gone, -1)) if r is not None]
        self.log += signed
        held = self._held()
        if self.frequent is None:
            self.frequent = self.scratch.save(_counts(held).where(F.col("n_docs") >= self.min_docs), "frequent")
            self._deal()
            return
        touched = _counts(held, F.max("batch").alias("batch")).where(F.col("batch") == self.batches).drop("batch")
        old = self.frequent.select("k1", "k2", F.lit(True).alias("was"))
        # Of the touched keys only those that are frequent, or were, are written.
        touched = touched.join(old, ["k1", "k2"], "left").where((F.col("n_docs") >= self.min_docs) | F.col("was"))
        touched = self.scratch.save(touched, "touched")
        now = F.col("n_docs") >= self.min_docs
        frequent = self.frequent.join(touched, ["k1", "k2"], "left_anti").union(touched.where(now).select("k1", "k2", "n_docs", "keep_doc"))
        frequent = self.scratch.save(frequent, "frequent")
        old_filters, old_frequent = self.filters, self.frequent
        self.frequent = frequent
        if frequent.count() > 2 * self.shards * self.keys_per_shard:
            self._deal()
        else:
            changed = update_filters(old_filters, touched.where(~now & F.col("was")), touched.where(now & F.col("was").isNull()), self.shards)
            changed = self.scratch.save(changed, "changed")
            full = changed.where("full").select("shard")
            again = frequent.withColumn("shard", _shard(self.shards)).join(F.broadcast(full), "shard", "left_semi")  # `shards` numbers at most
            self.filters = self.scratch.save(changed.where("not full").select("shard", "filter").union(filter_shards(again, self.shards)), "filters")
            self.scratch.drop(changed)
        for table in (old_filters, old_frequent, touched):
            self.scratch.drop(table)

    def _held(self) -> DataFrame:
        """(k1, k2, doc_id, n, batch): the references that all batches leave, and the last that touched them."""
        every = self.log[0]
        for part in self.log[1:]:
            every = every.union(part)
        return every.groupBy("k1", "k2", "doc_id").agg(F.sum("delta").alias("n"), F.max("batch").alias("batch"))

    def _deal(self) -> None:
        """Deals the frequent keys anew, into shards of about keys_per_shard."""
        self.shards = max(16, self.frequent.count() // self.keys_per_shard)
        self.filters = self.scratch.save(filter_shards(self.frequent, self.shards), "filters")

    def save(self, folder: str) -> None:
        """Writes the index to a folder that is kept: references that are left, counts, filters and sizes."""
        self._held().where("n <> 0").select("k1", "k2", "doc_id", F.col("n").alias("delta"), "batch").write.parquet(f"{folder}/references")
        self.frequent.write.parquet(f"{folder}/frequent")
        self.filters.write.parquet(f"{folder}/filters")
        sizes = [(self.batches, self.shards, self.min_docs, self.keys_per_shard)]
        self.scratch.spark.createDataFrame(sizes, "batches int, shards int, min_docs int, keys_per_shard int").coalesce(1).write.parquet(f"{folder}/sizes")

    @classmethod
    def open(cls, scratch: Scratch, folder: str) -> LineIndex:
        """An index that save() wrote, ready for more batches. What the folder holds isn't changed by them."""
        read = scratch.spark.read.parquet
        sizes = read(f"{folder}/sizes").first()
        index = cls(scratch, sizes.min_docs, sizes.keys_per_shard)
        index.batches, index.shards = sizes.batches, sizes.shards
        index.log, index.frequent, index.filters = [read(f"{folder}/references")], read(f"{folder}/frequent"), read(f"{folder}/filters")
        return index


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int")


def filter_shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of the keys in each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.built_from(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [made.table.tobytes()]})

    return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, gone: DataFrame, come: DataFrame, shards: int) -> DataFrame:
    """(shard, filter, full): filters after taking out the keys that stopped being frequent and adding those that became so.

    A shard has one filter, so a fingerprint that is taken out is the key's own, or one that stands for it as well. One
    without room for its new keys, or without a filter yet, is full: it must be built anew from its exact keys."""
    keyed = gone.select("k1", "k2", F.lit(True).alias("gone")).union(come.select("k1", "k2", F.lit(False).alias("gone"))).withColumn("shard", _shard(shards))

    def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(old) != 1:
            return pd.DataFrame({"shard": [key[0]], "filter": [b""], "full": [True]})
        table = CuckooFilter(np.frombuffer(old["filter"].iloc[0], np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())
        new = new.sort_values("gone", ascending=False, kind="stable")
        places = zip(*(x.tolist() for x in table._places(new["k1"].to_numpy(), new["k2"].to_numpy())))
        fits = all(table.discard(*place) if out else table.add(*place) for place, out in zip(places, new["gone"]))
        return pd.DataFrame({"shard": [key[0]], "filter": [table.table.tobytes()], "full": [not fits]})

    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(change, "shard int, filter binary, full boolean")


def probe(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The references whose keys their shard's filters may hold.

    References and filters meet by shard and salt: partitions are sorted so that the filters come first, and then stream
    past them. A hot line is one shard's, but spread over SALTS salts."""
    salted = refs.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), "k1", "k2", "doc_id")
    every = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "filter", *[F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc_id")])
    met = salted.union(every).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, []
        for batch in batches:
            shard, salt = (batch.column(i).to_numpy() for i in (0, 1))
            code = shard.astype(np.int64) * SALTS + salt
            is_filter = np.asarray(batch.column(2).is_valid())
            k1, k2 = (pc.fill_null(batch.column(i), 0).to_numpy() for i in (3, 4))
            cuts = np.flatnonzero(np.diff(code) | np.diff(is_filter.astype(np.int8))) + 1
            for part in np.split(np.arange(batch.num_rows), cuts):
                first = part[0]
                if code[first] != at:
                    at, now = code[first], []
                if is_filter[first]:
                    now += [CuckooFilter(np.frombuffer(batch.column(2)[int(i)].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS)) for i in part]
                elif now:
                    hit = np.any([f.contains(k1[part], k2[part]) for f in now], axis=0)
                    rows = batch.take(pa.array(part[hit]))
                    yield pa.RecordBatch.from_arrays([rows.column(i) for i in (3, 4, 5, 1)], names=["k1", "k2", "doc_id", "salt"])

    return met.mapInArrow(run, "k1 long, k2 long, doc_id long, salt int")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_per_shard: int = 100_000) -> DataFrame:
    """docs with text deduplicated, and n_lines (before) and n_dropped added."""
    scratch = Scratch(docs.sparkSession, "lines")
    source = docs.drop("n_lines", "n_dropped")
    refs = scratch.save(references(source, min_chars), "references")
    index = LineIndex(scratch, min_docs, keys_per_shard)
    index.apply(come=refs)
    return drop_frequent(source, refs, index, min_chars)


def dedup_lines_in_batches(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keys_per_shard: int = 100_000, parts: int = 16) -> DataFrame:
    """dedup_lines() by way of changes: all documents but a part are inserted, then that part while another is deleted, then
    the deleted part again. Parts are cut by the hash of doc_id; the index, and so the result, is that of one insertion."""
    scratch = Scratch(docs.sparkSession, "lines")
    source = docs.drop("n_lines", "n_dropped")
    refs = scratch.save(references(source, min_chars), "references")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    index = LineIndex(scratch, min_docs, keys_per_shard)
    index.apply(come=refs.where(part != 0))
    index.apply(come=refs.where(part == 0), gone=refs.where(part == 1))
    index.apply(come=refs.where(part == 1))
    return drop_frequent(source, refs, index, min_chars)


def drop_frequent(source: DataFrame, refs: DataFrame, index: LineIndex, min_chars: int = MIN_CHARS) -> DataFrame:
    """source without the lines that index counts as frequent, but for each one's largest document. refs are source's references."""
    likely = probe(refs, index.filters, index.shards)
    exact = index.frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = likely.join(exact.hint("merge"), ["k1", "k2", "salt"])  # the counts grow with the corpus and are never broadcast
    lost = lost.where("doc_id is null or doc_id <> keep_doc")
    drops = lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("__drop")).withColumnRenamed("doc_id", "__doc")
    joined = source.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    return _drop_lines(joined, source.columns, source.schema, min_chars)


def _drop_lines(joined: DataFrame, columns: list[str], schema: T.StructType, min_chars: int) -> DataFrame:
    at_text, out = columns.index("text"), T.StructType(schema.fields + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = pc.fill_null(part.column(at_text), "")
                n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
                dropped = np.zeros(part.num_rows, dtype=np.int64)
                touched = np.flatnonzero(np.asarray(part.column(len(columns)).is_valid()))
                if len(touched):
                    new = texts.to_pylist()
                    lines, per_doc, long, keys = _line_keys(texts.take(pa.array(touched)), min_chars)
                    lines, ends = lines.to_pylist(), np.cumsum(per_doc)
                    starts, firsts = ends - per_doc, np.searchsorted(long, ends - per_doc)
                    lasts = np.searchsorted(long, ends)
                    for k, row in enumerate(touched):
                        gone = {(d["k1"], d["k2"]) for d in part.column(len(columns))[int(row)].as_py()}
                        out_lines = {int(long[i]) for i in range(firsts[k], lasts[k]) if (int(keys[i, 0]), int(keys[i, 1])) in gone}
                        new[row] = "\n".join(lines[i] for i in range(starts[k], ends[k]) if i not in out_lines)
                        dropped[row] = len(out_lines)
                    texts = pa.array(new, pa.string())
                cols = [texts if i == at_text else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*cols, n_lines, pa.array(dropped)], names=out.names)

    return joined.mapInArrow(run, out)
