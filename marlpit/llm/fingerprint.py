"""Document fingerprints by content-defined chunking: sets of chunk digests, weighted by length.

A text's UTF-8 bytes run through a gear hash of 16 bits, so that a boundary depends on the last 16 bytes alone. Chunks are
cut where bits of the hash are zero, normalised: between `least` and `normal` bytes after the last cut four bits must be
zero, from there on two, and at `most` bytes a chunk ends in any case (so short that a text of a dozen words has several). A boundary before an edit stays, and one soon
after it falls on the same bytes again, wherever these have moved to.

A fingerprint is the set of distinct chunks, each with its length in bytes and 48 bits of its xxHash, in order of the digest, as
base64 of seven bytes a chunk. Its likeness to another is containment: the bytes of its chunks that the other has too, of
the bytes of its chunks. It takes nothing but two fingerprints, so they can be kept and compared without their texts.

`compare_neighbours` sets every document beside the next one in descending order of doc_id. Documents are dealt into
ranges of doc_id; the first of every range goes to the range before as well, so every task has the neighbour of its
last document, and each text is shuffled once.

Defined results for odd input: a null text is empty; an empty text has the fingerprint ''; two equal fingerprints have
likeness 1, and an empty one has 0 to others; null doc_ids come after all others; rows of one doc_id are in order of their
texts' hashes, then of the texts (rows with both in common go through one task, one after the other); the last document's
neighbour is the first, in a table of one row the row itself; very long texts are one row and one task's memory; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import shuffle_width, text_or_empty

GEAR = np.random.default_rng(13).integers(0, 1 << 16, 256, dtype=np.uint16)
WINDOW = 16
CHUNK_BYTES = 7
#: Ranges for each id that holds many rows.
HOT_SLOTS = 64
SLICE = 256


@dataclass(frozen=True)
class Chunker:
    """Chunk lengths in bytes (at most 255); strict and loose are the bits that must be zero before and after the normal length."""

    least: int = 8
    normal: int = 16
    most: int = 64
    strict: int = 0xF000
    loose: int = 0xC000

    def cuts(self, data: bytes) -> list[int]:
        """The ends of the chunks of data."""
        n = len(data)
        h = GEAR[np.frombuffer(data, np.uint8)]
        reach = 1
        while reach < WINDOW:  # sums over windows, doubled
            h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
            reach *= 2
        places = np.flatnonzero((h & self.loose) == 0)
        is_strict = (h[places] & self.strict) == 0
        out, start = [], 0
        for end, strict in zip((places + 1).tolist(), is_strict.tolist()):
            while end - start > self.most:
                start += self.most
                out.append(start)
            if end - start >= self.normal or (strict and end - start >= self.least):
                start = end
                out.append(end)
        while n - start > self.most:
            start += self.most
            out.append(start)
        return [*out, n] if start < n else out

    def weights(self, data: bytes) -> dict[bytes, int]:
        """The chunks of data: digest -> length."""
        out, start, view = {}, 0, memoryview(data)
        for end in self.cuts(data):
            out[xxhash.xxh3_64_digest(view[start:end])[:6]] = end - start
            start = end
        return out


DEFAULT = Chunker()


def pack(weights: dict[bytes, int]) -> str:
    return base64.b64encode(b"".join(d + bytes((weights[d],)) for d in sorted(weights))).decode()


def unpack(fingerprint: str) -> dict[bytes, int]:
    data = base64.b64decode(fingerprint)
    return {data[i : i + 6]: data[i + 6] for i in range(0, len(data), CHUNK_BYTES)}


def likeness(own: dict[bytes, int], other: dict[bytes, int]) -> float:
    """The share of own's bytes that are in chunks of other."""
    if not own:
        return float(not other)
    return sum(map(own.__getitem__, own.keys() & other.keys())) / sum(own.values())


def fingerprints(docs: DataFrame, chunker: Chunker = DEFAULT) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(chunker.weights(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    slim = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbour_ranges(docs: DataFrame, n_ranges: int) -> DataFrame:
    """docs (doc_id, text, hash) with `range` and `tail`: ranges follow each other in descending doc_id, null last. A row with
    tail is a first of the next range (of the first range, after the last).

    Ids that fill a range alone, and null, are dealt further by the hash of the text."""
    steps = [i / n_ranges for i in range(1, n_ranges)]
    found = docs.agg(F.percentile_approx("doc_id", steps, 10 * n_ranges).alias("bounds"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = found.bounds or []  # n_ranges numbers at most
    hot = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    marks = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>")
    # How many bounds lie below the id, by halving. One expression over a list of steps: as a chain of columns it would be
    # put into itself again and again by the optimizer.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(marks, low + step - 1) < F.col("doc_id"), F.lit(False)), low + step).otherwise(low))
    slot = F.shiftright((F.shiftright("hash", 32) + F.lit(1 << 31)) * F.lit(HOT_SLOTS), 32)
    place = -2 * HOT_SLOTS * F.col("range")
    is_hot = F.col("doc_id").isNull() | F.array_contains(F.array(*map(F.lit, hot)), F.col("doc_id")) if hot else F.col("doc_id").isNull()
    placed = docs.select("*", below.alias("range"), is_hot.alias("hot"))
    placed = placed.withColumn("range", F.when(F.col("doc_id").isNull(), 2 * HOT_SLOTS + slot).when(F.col("hot"), place + slot).otherwise(place + HOT_SLOTS))
    # A range's first rows have its largest id and, where that id is hot, the least hash; texts are read for it only then.
    least = F.min("hash") if hot or found.nulls else F.lit(None).cast("long")
    firsts = placed.groupBy("range").agg(F.max("doc_id").alias("__id"), least.alias("__hash"))
    firsts = firsts.withColumn("__before", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy())))
    joined = placed.join(F.broadcast(firsts.withColumnRenamed("range", "__of")), F.col("range") == F.col("__of"))
    is_first = F.when(F.col("hot"), F.col("hash") == F.col("__hash")).otherwise(F.col("doc_id") == F.col("__id"))
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    both = F.array(own, F.struct(F.col("__before").alias("range"), F.lit(True).alias("tail")))
    return joined.withColumn("__to", F.explode(F.when(is_first, both).otherwise(F.array(own)))).select("doc_id", "text", "hash", "__to.range", "__to.tail")


def compare_neighbours(docs: DataFrame, chunker: Chunker = DEFAULT, n_ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A document's edited text has the last half of its code points (rounded down) replaced by as many of the first of its
    neighbour, or by all of them."""
    tasks = shuffle_width(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    ranged = neighbour_ranges(slim, n_ranges or min(2000, 8 * tasks))
    # Tails come last in their range, whatever their ids.
    ordered = ranged.repartition(tasks, "range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before, closed, out, held = None, None, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for doc_id, text, rng, tail in zip(*(part.column(i).to_pylist() for i in range(4))):
                if tail and closed == rng:  # other copies of the first row
                    continue
                weights = chunker.weights(text.encode())
                if before is not None and before[3] == rng:
                    own_id, own_text, own, _ = before
                    half = len(own_text) // 2
                    edited = (own_text[: len(own_text) - half] + text[:half]).encode()
                    other = chunker.weights(edited)
                    row = own_id, len(own_text), hashlib.sha256(edited).hexdigest(), pack(own), pack(other), likeness(own, other), likeness(own, weights)
                    out.append(row)
                    held += len(row[3]) + len(row[4])
                if tail:
                    before, closed = None, rng
                else:
                    before = doc_id, text, weights, rng
                if held > 1 << 22:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "range", "tail").mapInArrow(run, schema)
