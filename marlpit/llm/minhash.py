"""Near-duplicates by improved consistent weighted sampling (Ioffe, 2010) over TF-IDF shingles, banded and verified.

1. Shingles are five words of the lower-cased text. A shingle weighs tf * idf, idf = 1 + ln(N / df) / ln(SMOOTH), where df is
   the exact number of documents that hold it, for every shingle of the table. Documents are packed into blocks of about
   BLOCK_BYTES. A block counts its distinct shingles and sends them, in order and cut by ranges of the hash, to be summed
   over all blocks; the sums come back to the block in the same order, so only numbers travel back, and no task holds more
   than a block or a range. The driver gets the number of rows and of bytes, nothing else.
2. Equal texts are one class and go on as one. A class of n rows shares with other texts only shingles found in more than
   n documents. Where the others carry more than 1 - THRESHOLD of its weight, with idf and without, no text can be similar
   enough, and the class is left out of what follows: the bound is exact, and on natural text few classes are left.
3. These get HASHES samples (shingle, level); two documents agree in one with the probability of their weighted Jaccard
   similarity. BANDS bands of ROWS samples are the first keys.
4. In a round the LEADERS members of lowest hash under a key are compared with those that follow them and aren't yet in
   their component, then leave the key. Keys that had more than FEW members are dealt anew, by further samples of the
   other bands, twice as many in each round: similar texts stay together, and groups that only resemble each other fall apart. So
   a round makes at most LEADERS pairs a member, whatever the size of a group, and rounds are few. A round goes on with
   those keys that hold several components; the last leaves none. Pairs are verified on
   all shingles of both texts.
5. Rounds join most of a large group, but not surely all of it. So in the end every first key that had too many members for
   its leaders to meet them all is gone through whole: its members outside its largest component are compared with all
   members of other components, in blocks, by products of their shingles. After that any two texts under a first key have been compared or are in one component.
6. Links at THRESHOLD or more make components; the smallest doc_id stays.
7. Copies make the shingles of their own text common, so that a few words of a near copy would outweigh all that it shares
   with a large group, the more the larger the group and the table. So towards a group, a component of two rows or more, the
   shingles of which it holds the most part count as found in one document: those in at most MOST_PART times as many
   documents as it has rows. needed() gives the least number that brings two texts to THRESHOLD; such links wait until one
   of their components is that large, and join it. A passage that other texts hold as well keeps its low weight.

The last step has as many pairs as a key's members outside its largest component times its members: its work grows with the
square of a key only where that key joins many texts that are not similar. What the first keys don't bring together isn't
found; the README gives the measured share of all links (by brute force) whose ends come together.

Defined results for odd input: texts without words (null, empty, white space) are alike only to equal texts, null equalling
empty; texts of fewer than five words are one shingle; a very long text is a block of its own; rows without doc_id are left
out of links and are their own; rows that share a doc_id count once; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlpit.llm.common import Scratch
from marlpit.llm.components import connected_components

WORDS, THRESHOLD, SMOOTH = 5, 0.8, 100
BANDS, ROWS = 16, 5
HASHES = BANDS * ROWS
SLICE = 256
LEADERS, FEW = 4, 4
#: A group has the most part of the documents that hold a shingle if these are at most so many times its rows.
MOST_PART = 2
#: Members of a crowded key that meet as many others in one task, and shingles of these taken at once.
GROUP, FEATURES = 256, 8192
#: A text as a weighted set.
SET = ("shingles", "tf", "df")
#: Bytes of text for a block of documents and for a range of hashes; small tables have smaller ranges, but no more than FEW_RANGES.
BLOCK_BYTES, LEAST_RANGE, FEW_RANGES = 4 << 20, 1 << 20, 128
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Hashes of the shingles of many texts at once.

    With random values v for bytes, words have hashes sum(v[byte] * P ** place) mod 2**64: differences of one running sum
    over the bytes of all texts, moved to place 0 by the inverse of P. Five of them, mixed in order, make a shingle."""

    BYTES = 1 << 20

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.is_space = np.zeros(256, dtype=bool)
        self.is_space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, by in (("powers", self.base), ("inverses", self.inverse)):
                row = np.full(size, by & ((1 << 64) - 1), dtype=np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many of them come before each text and its end."""
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        self._grow(len(raw))
        gap = self.is_space[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=total[1:])
        words = (total[ends] - total[starts]) * self.inverses[starts]
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        return words ^ (words >> np.uint64(32)), np.searchsorted(starts, bounds)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text its shingles in order. Texts are taken together up to BYTES bytes."""
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append((t or "").lower().encode())
            size += len(part[-1])
            if size >= self.BYTES:
                yield from self._part(part)
                part, size = [], 0
        if part:
            yield from self._part(part)

    def _part(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        words, at = self._words(texts)
        whole = self._mixed(words, WORDS) if len(words) >= WORDS else words
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield whole[lo : hi - WORDS + 1] if hi - lo >= WORDS else self._mixed(words[lo:hi], hi - lo)

    @staticmethod
    def _mixed(h: np.ndarray, size: int) -> np.ndarray:
        if not size:
            return h
        out = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = (out ^ h[i : len(h) - size + 1 + i]) * _MULTIPLY
            out ^= out >> np.uint64(29)
        out *= _MIX
        return out ^ (out >> np.uint64(32))


_shingles = Shingler()


def _gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of 2**bits equal steps, by Newton on 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x / 4, x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)))
    return x


class Sampler:
    """HASHES consistent weighted samples of a weighted set.

    r and c are drawn from Gamma(2, 1) and b from [0, 1) by hashes of the shingle and the sample's number alone. The
    sample is the shingle with the least c / (y e^r), y = exp(r (t - b)), t = floor(ln(weight) / r + b).

    As t - b > ln(weight) / r - 1, the logarithm of that is above ln(c) - r - ln(weight). The first 16 bits of a hash give
    c to 10 bits and r to 6, and a table of these bounds tells which shingles can be the least; only they are computed."""

    PARTS, FEW = 16, 200

    def __init__(self, n: int = HASHES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.multiply = rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gamma = _gamma_table()
        self.r, self.log_c = gamma, np.log(gamma)
        bin_c, bin_r = np.arange(1 << 16) >> 6, np.arange(1 << 16) & 63
        self.bound = (self.log_c[bin_c << 6] - self.r[(bin_r << 10) | 1023] - 1e-4).astype(np.float32)

    def _exact(self, x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and t of hashes x. Bits from the top: 10 of c, 6 of r, 6 of c, 10 of r, and 32 of b."""
        high = (x >> np.uint64(32)).astype(np.int64)
        c = ((high >> 22) << 6) | ((high >> 10) & 63)
        r = self.r[(((high >> 16) & 63) << 10) | (high & 1023)]
        b = x.astype(np.uint32).astype(np.float64) * 2.0**-32
        t = np.floor(log_w / r + b)
        return self.log_c[c] - (t - b + 1) * r, t

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.multiply)
        best, chosen, level = np.full(n, np.inf), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        log_w = np.log(weights)
        every = np.arange(n)[:, None]
        for i in range(0, len(shingles), block):
            own, own_w = shingles[i : i + block], log_w[i : i + block]
            x = self.multiply[:, None] * own + self.add[:, None]
            if len(own) < self.FEW:
                value, t = self._exact(x, own_w)
                k = value.argmin(1)
                rows = np.flatnonzero(value[every[:, 0], k] < best)
                k = k[rows]
                best[rows], chosen[rows], level[rows] = value[rows, k], own[k], t[rows, k].astype(np.int64)
                continue
            low = self.bound.take((x >> np.uint64(48)).view(np.int64))
            low -= own_w.astype(np.float32)
            # The shingles of the least bounds, one in each of PARTS runs, are guesses; what is bounded above the best value can't be less.
            parts = min(self.PARTS, len(own))
            size = len(own) // parts
            k = low[:, : parts * size].reshape(n, parts, size).argmin(2) + np.arange(parts) * size
            guess = np.minimum(best, self._exact(x[every, k], own_w[k])[0].min(1))
            flat = np.flatnonzero(low <= (guess + 1e-5).astype(np.float32)[:, None])
            at, k = flat // len(own), flat % len(own)
            value, t = self._exact(x.ravel()[flat], own_w[k])
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            least = np.minimum.reduceat(value, heads)
            rows = at[heads]
            hit = np.flatnonzero(value == np.repeat(least, np.diff(np.append(heads, len(at)))))
            hit = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
            better = least < best[rows]
            hit, rows = hit[better], rows[better]
            best[rows], chosen[rows], level[rows] = value[hit], own[k[hit]], t[hit].astype(np.int64)
        return chosen, level


def tf_idf(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """The weights of distinct shingles: how often the text has them, in how many of n documents they are."""
    return tf * (1 + np.log(n / df) / math.log(SMOOTH))


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array by place, so that the zeros of small values lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def pack_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows, bytes, data): runs of documents of about block_bytes of text, each a compressed Arrow stream (doc_id, text)."""

    def packed(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for batch in held:
                to.write_batch(batch)
        rows = sum(b.num_rows for b in held)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([rows], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows", "bytes", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - size)) + 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - before
                lo = hi
                if size >= block_bytes:
                    yield packed(held, size)
                    held, size = [], 0
        if held:
            yield packed(held, size)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block string, rows long, bytes long, data binary")


def _opened(data: bytes) -> tuple[list[int | None], list[str]]:
    table = pa.ipc.open_stream(data).read_all()
    return table.column(0).to_pylist(), pc.fill_null(table.column(1), "").to_pylist()


def document_counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """(block, range, df): in how many rows of the table each distinct shingle of the block is, in order of range and shingle."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                times = Counter(_opened(data.as_py())[1])
                seen = [np.unique(s) for s in _shingles(list(times))]
                keys, at = np.unique(np.concatenate(seen), return_inverse=True)
                df = np.bincount(at, np.repeat(np.fromiter(times.values(), dtype=np.float64), [len(s) for s in seen]), len(keys)).astype(np.uint32)
                place = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                heads = np.flatnonzero(np.diff(place, prepend=-1))
                cuts = list(zip(heads.tolist(), [*heads[1:].tolist(), len(keys)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(cuts), pa.string()),
                        pa.array(place[heads], pa.int32()),
                        pa.array([pack(np.diff(keys[lo:hi], prepend=np.uint64(0))) for lo, hi in cuts], pa.binary()),
                        pa.array([pack(df[lo:hi]) for lo, hi in cuts], pa.binary()),
                    ],
                    names=["block", "range", "keys", "df"],
                )

    def total(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        here = np.concatenate([unpack(d, np.uint32) for d in table.column("df").to_pylist()])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(at, here)[at].astype(np.uint32)
        ends = np.cumsum([len(p) for p in parts]).tolist()
        packed = [pack(df[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        return pa.table([table.column("block"), table.column("range"), pa.array(packed, pa.binary())], names=["block", "range", "df"])

    named = blocks.select("block", "data").mapInArrow(name, "block string, range int, keys binary, df binary")
    return named.groupBy("range").applyInArrow(total, "block string, range int, df binary")


def lone_until(df: np.ndarray, weights: np.ndarray) -> int:
    """The least d such that shingles found in at most d rows carry more than 1 - THRESHOLD of the weight: a text of d rows
    or more has no partner, as those shingles may all be its own."""
    most = (1 - THRESHOLD) * weights.sum() * (1 + 1e-9)
    if weights[df == 1].sum() > most:
        return 1
    order = np.argsort(df, kind="stable")
    return int(df[order][np.searchsorted(np.cumsum(weights[order]), most, side="right")])


def signatures(blocks: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, alone, weight, buckets, samples, shingles, tf, df), one row for each row of the table.

    digest is of the whole text, alone the larger lone_until() of the weights with idf and without. What follows is null unless the text may have a partner, and is
    given once for equal texts of a block, with their smallest doc_id: the weight of the whole text, a key for each band,
    the samples, and its distinct shingles in order, how often it has them and in how many documents they are, packed."""

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        sample = Sampler()
        lift = np.arange(1, HASHES + 1, dtype=np.uint64) * _MULTIPLY
        ids, texts = [], []
        for data in rows.column("data"):
            some, them = _opened(data.as_py())
            ids += some
            texts += them
        digests = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        once = dict(zip(digests, texts))
        least: dict[bytes, int] = {}
        for i, d in zip(ids, digests):
            if i is not None and i <= least.get(d, i):
                least[d] = i
        shingles = list(_shingles(list(once.values())))
        keys = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, dtype=np.uint64)
        df = np.concatenate([np.zeros(0, dtype=np.uint32), *(unpack(d, np.uint32) for d in counts.sort_by("range").column("df").to_pylist())])
        if len(df) != len(keys):
            raise ValueError("document counts are those of another block")
        alone: dict[bytes, int] = {}
        made: dict[bytes, tuple] = {}
        for d, s in zip(once, shingles):
            alone[d] = 1
            if not len(s):
                continue
            distinct, tf = np.unique(s, return_counts=True)
            own = df[np.searchsorted(keys, distinct)]
            weights = tf_idf(tf, own, n)
            alone[d] = max(lone_until(own, weights), lone_until(own, tf.astype(np.float64)))
            if alone[d] == 1 or d not in least:
                continue
            chosen, level = sample(distinct, weights)
            x = (chosen ^ (level.view(np.uint64) * _MIX)) * _MULTIPLY + lift
            x ^= x >> np.uint64(31)
            bands = np.zeros(BANDS, dtype=np.uint64)
            for column in x.reshape(BANDS, ROWS).T:
                bands = (bands ^ column) * _MIX
                bands ^= bands >> np.uint64(32)
            made[d] = float(weights.sum()), bands.view(np.int64).tolist(), x.astype(np.uint32).view(np.int32).tolist(), pack(np.diff(distinct, prepend=np.uint64(0))), pack(tf.astype(np.uint32)), pack(own)
        lead = [made.pop(d, (None,) * 6) if i is not None and least[d] == i else (None,) * 6 for i, d in zip(ids, digests)]
        weight, buckets, samples, *sets = zip(*lead) if lead else [()] * 6
        return pa.table(
            [
                pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([alone[d] for d in digests], pa.int64()), pa.array(weight, pa.float64()),
                pa.array(buckets, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int32())), *[pa.array(x, pa.binary()) for x in sets],
            ],
            names=["doc_id", "digest", "alone", "weight", "buckets", "samples", *SET],
        )

    both = blocks.select("block", "data").groupBy("block").cogroup(counts.groupBy("block"))
    return both.applyInArrow(run, "doc_id long, digest binary, alone long, weight double, buckets array<bigint>, samples array<int>, shingles binary, tf binary, df binary")


def needed(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n: int) -> int | None:
    """The least d with a similarity of THRESHOLD or more when shingles in at most d of n documents count as found in one
    (0: as they are); none if there is no such d. a and b: shingles in order, tf, df."""
    if weighted_jaccard(*((keys, tf_idf(tf, df, n)) for keys, tf, df in (a, b))) >= THRESHOLD:
        return 0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return None
    least, own = np.minimum(a[1][i], b[1][j]), a[2][i]
    df, tf = np.concatenate([a[2], b[2]]), np.concatenate([a[1], b[1]])
    levels = np.unique(own)

    def sums(df: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The weight of all, at each level: counting as found in one adds ln(df) / ln(SMOOTH)."""
        gains = np.bincount(np.minimum(np.searchsorted(levels, df), len(levels)), tf * np.log(df) / math.log(SMOOTH), len(levels) + 1)
        return tf_idf(tf, df, n).sum() + np.cumsum(gains[:-1])

    met, whole = sums(own, least), sums(df, tf)
    enough = np.flatnonzero(met >= THRESHOLD * (whole - met))
    return int(levels[enough[0]]) if len(enough) else None


def similarities(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (a, b and other columns) with needed() of the whole texts, where there is one. texts has doc and SET."""
    left = texts.select(F.col("doc").alias("a"), F.struct(*SET).alias("set_a"))
    right = texts.select(F.col("doc").alias("b"), F.struct(*SET).alias("set_b"))
    met = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "set_a", "set_b")
    schema = T.StructType(pairs.schema.fields + [T.StructField("needed", T.LongType())])
    lead, width = pairs.columns.index("b"), len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = []
                for b, x, y in zip(part.column(lead).to_pylist(), part.column(width), part.column(width + 1)):
                    if b != last:
                        last, counts = b, _opened_counts(y.as_py())
                    found.append(needed(_opened_counts(x.as_py()), counts, n))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(found, pa.int64())], names=schema.names)

    return met.mapInArrow(run, schema).where("needed is not null")


def _further(turn: int) -> list[Column]:
    """The samples that deal a key anew after a round: 2**turn of the other bands', or all of these."""
    others = HASHES - ROWS
    return [F.element_at("samples", ((F.col("band") + 1) * ROWS + (2**turn - 1 + k) % others) % HASHES + 1) for k in range(min(2**turn, others))]


def _joined(links: DataFrame) -> DataFrame:
    """(id, label) of components (component, lead_component) that links join: those with one label are linked, those with
    two may be as well. Two steps to the least neighbour, with a jump between them, see through a star."""
    edges = links.select(F.col("component").alias("u"), F.col("lead_component").alias("v"))
    edges = edges.union(edges.select("v", "u")).distinct()
    first = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label"))
    jump = first.join(first.select(F.col("u").alias("of"), F.col("label").alias("further")), F.col("label") == F.col("of")).select("u", F.least("label", "further").alias("label"))
    near = edges.join(jump.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("least"))
    return jump.join(near, "u").select(F.col("u").alias("id"), F.least("label", "least").alias("label"))


def _opened_counts(one: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpack(one["shingles"], np.uint64), dtype=np.uint64), unpack(one["tf"], np.uint32).astype(np.float64), unpack(one["df"], np.uint32)


def _opened_set(shingles: bytes, tf: bytes, df: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys, times, found = _opened_counts({"shingles": shingles, "tf": tf, "df": df})
    return keys, tf_idf(times, found, n)


def _levels(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' shingles (text, feature, weight), each as often as a text has it: its k-th time is a feature of its own,
    so that the smaller of two weights is what both texts have in common."""
    texts, features, weights = [], [], []
    for i, one in enumerate(table.select(list(SET)).to_pylist()):
        keys, tf = np.cumsum(unpack(one["shingles"], np.uint64), dtype=np.uint64), unpack(one["tf"], np.uint32).astype(np.int64)
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        features.append(np.repeat(keys, tf) ^ (level.astype(np.uint64) * _MIX))
        weights.append(np.repeat(tf_idf(np.ones(len(tf)), unpack(one["df"], np.uint32), n), tf))
        texts.append(np.full(len(level), i))
    return np.concatenate(texts), np.concatenate(features), np.concatenate(weights)


def _block_sums(left: pa.Table, right: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts on the left with all on the right the weight and the number of common shingles, and the weight of both, by
    products of slices."""
    sides = [_levels(t, n) for t in (left, right)]
    shared = np.intersect1d(sides[0][1], sides[1][1])
    met = np.zeros((2, left.num_rows, right.num_rows))
    kept = []
    for text, feature, weight in sides:
        at = np.minimum(np.searchsorted(shared, feature), max(len(shared) - 1, 0))
        here = np.flatnonzero(shared[at] == feature) if len(shared) else np.zeros(0, dtype=np.int64)
        here = here[np.argsort(at[here], kind="stable")]
        kept.append((text[here], at[here], weight[here]))
    for lo in range(0, len(shared), FEATURES):
        width = min(FEATURES, len(shared) - lo)
        (text, at, weight), (other, other_at, _) = [[x[slice(*np.searchsorted(k[1], [lo, lo + FEATURES]))] for x in k] for k in kept]
        heavy, light = np.zeros((2, left.num_rows, width)), np.zeros((right.num_rows, width))
        heavy[0, text, at - lo], heavy[1, text, at - lo], light[other, other_at - lo] = weight, 1.0, 1.0
        met += heavy @ light.T
    whole = [np.bincount(text, weight, t.num_rows) for (text, _, weight), t in zip(sides, (left, right))]
    return met[0], met[1], whole[0][:, None] + whole[1]


def block_similarities(left: pa.Table, right: pa.Table, n: int) -> np.ndarray:
    """Weighted Jaccard similarities of all texts on the left with all on the right, to about 1e-9."""
    met, _, whole = _block_sums(left, right, n)
    return met / (whole - met)


def crowded_links(texts: DataFrame, state: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(a, b, needed): links under first keys between two components (state) that the rounds may not have compared: point 5 above.

    A task takes at most about GROUP of a key's members and as many of those outside its largest component, and returns
    the links that join their components, so no pair is a row. A link is left out only where others that need no more
    join the same two: they wait for no larger group."""
    own = texts.select("doc", F.explode("buckets").alias("key")).join(state, "doc")
    held = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = F.max_by("component", F.struct("n", "component")).alias("main")
    # The leaders of a key of LEADERS + 1 members have met all of it.
    crowded = held.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("components"), main).where(f"components > 1 and n > {LEADERS + 1}")
    own = scratch.save(own.join(crowded.select("key", "main", F.ceil(F.col("n") / GROUP).alias("parts"), F.ceil((F.col("n") - F.col("most")) / GROUP).alias("other_parts")), "key"), "crowded")
    place, every = (lambda of: F.pmod(F.xxhash64("doc"), of)), (lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)))
    sets = texts.select("doc", *SET)
    some = ["key", "part", "other_part", "doc", "component", "main"]
    left = own.withColumn("part", place("parts")).withColumn("other_part", every("other_parts")).select(some).join(sets, "doc")
    right = own.where("component <> main").withColumn("other_part", place("other_parts")).withColumn("part", every("parts")).select(some).join(sets, "doc")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table

    def run(members: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if members.num_rows and others.num_rows:
            met, number, whole = _block_sums(members, others, n)
            # No similarity with some shingles counted as found in one document is above the one with just the common ones.
            lone = number * tf_idf(1, 1, n)
            most = lone / (lone + whole - 2 * met)
            doc, other = members["doc"].to_numpy(), others["doc"].to_numpy()
            group, other_group = members["component"].to_numpy(), others["component"].to_numpy()
            apart = (group[:, None] != other_group) & ((group == members["main"].to_numpy())[:, None] | (doc[:, None] < other))
            i, j = np.nonzero(apart & (most >= THRESHOLD - 1e-6))
            likely = met[i, j] >= (THRESHOLD - 1e-6) * (whole[i, j] - met[i, j])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            def joins(k: int) -> bool:
                return root(int(group[i[k]])) != root(int(other_group[j[k]]))

            def link(k: int, need: int) -> None:
                x, y = root(int(group[i[k]])), root(int(other_group[j[k]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((int(doc[i[k]]), int(other[j[k]]), need))

            @lru_cache(2 * GROUP)
            def opened(side: int, at: int) -> tuple[np.ndarray, ...]:
                return _opened_counts({c: (members, others)[side][c][at].as_py() for c in SET})

            def needs(k: int) -> int | None:
                return needed(opened(0, int(i[k])), opened(1, int(j[k])), n)

            for k in sorted(np.flatnonzero(likely).tolist(), key=lambda k: -most[i[k], j[k]]):
                if joins(k) and needs(k) == 0:
                    link(k, 0)
            waiting = [(need, k) for k in range(len(i)) if joins(k) and (need := needs(k)) is not None]
            for need, k in sorted(waiting):
                link(k, need)
        a, b, need = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(x, pa.int64()) for x in (a, b, need)], names=["a", "b", "needed"])

    keys = ["key", "part", "other_part"]
    return scratch.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long, needed long"), "rest")


def grouped(links: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, component) of those texts (doc, rows) that links (a, b, needed) join: those that need nothing first, then again
    and again those that one of their components is large enough for."""
    waiting = scratch.save(links.where("needed > 0").groupBy("a", "b").agg(F.min("needed").alias("needed")), "waiting")
    joined = connected_components(links.where("needed = 0"), scratch)
    while True:
        named = rows.join(joined.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        sizes = named.groupBy("component").agg(F.sum("rows").alias("size"))
        sized = named.join(sizes, "component").select("doc", "component", "size")
        met = waiting
        for end in ("a", "b"):
            met = met.join(sized.select(F.col("doc").alias(end), F.col("component").alias(f"component_{end}"), F.col("size").alias(f"size_{end}")), end)
        most = F.greatest("size_a", "size_b")
        more = scratch.save(met.where((F.col("component_a") != F.col("component_b")) & (most > 1) & (most * MOST_PART >= F.col("needed"))).select("component_a", "component_b").distinct(), "more")
        if more.isEmpty():
            return joined.withColumnRenamed("id", "doc")
        joined = connected_components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch)


def linked(texts: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(doc, component) of those texts (doc, buckets, samples and SET) that have links: see points 4, 5 and 7 above. Each
    text stands for as many rows as its column rows tells; without that column for one."""
    state = scratch.save(texts.select("doc", F.col("doc").alias("component")), "state")
    members = texts.select("doc", F.posexplode("buckets").alias("band", "key"))
    used: list[DataFrame] = []
    links: list[DataFrame] = []
    for turn in itertools.count():
        own = members.join(state, "doc")
        open_keys = own.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "n")
        own = scratch.save(own.join(open_keys, "key").withColumn("turn", F.xxhash64("doc", F.lit(turn))), "open")
        for table in used:
            scratch.drop(table)
        if own.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy("turn", "doc"))
        leaders = scratch.save(own.select("key", "doc", "turn", "component", place.alias("place")).where(F.col("place") <= LEADERS).drop("place"), "leaders")
        heads = leaders.select("key", *[F.col(c).alias(f"lead_{c}") for c in ("doc", "turn", "component")])
        later = (F.col("turn") > F.col("lead_turn")) | ((F.col("turn") == F.col("lead_turn")) & (F.col("doc") > F.col("lead_doc")))
        met = own.join(heads, "key").where((F.col("component") != F.col("lead_component")) & later)
        pairs = met.select(F.col("doc").alias("a"), F.col("lead_doc").alias("b"), "component", "lead_component").distinct()
        new = scratch.save(similarities(pairs, texts, n), "links")
        links.append(new.select("a", "b", "needed"))
        new = new.where("needed = 0")
        if not new.isEmpty():
            relabelled = state.join(_joined(new), F.col("component") == F.col("id"), "left")
            relabelled = scratch.save(relabelled.select("doc", F.coalesce("label", "component").alias("component")), "state")
            scratch.drop(state)
            state = relabelled
        rest = own.join(leaders.select("key", "doc"), ["key", "doc"], "left_anti").select("key", "band", "doc", "n")
        many = rest.where(F.col("n") > FEW).join(texts.select("doc", "samples"), "doc").withColumn("key", F.xxhash64("key", *_further(turn)))
        members = rest.where(F.col("n") <= FEW).select("doc", "band", "key").union(many.select("doc", "band", "key"))
        used = [own, leaders]
    links.append(crowded_links(texts, state, n, scratch))
    rows = texts.select("doc", F.col("rows") if "rows" in texts.columns else F.lit(1).alias("rows"))
    return grouped(reduce(DataFrame.union, links), rows, scratch)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same text), component_id (smallest doc_id reached by links), kept.

    links are between classes; a document is kept if it is the smallest of its component."""
    scratch = Scratch(docs.sparkSession, "minhash")
    blocks = scratch.save(pack_documents(docs), "blocks")
    n, size = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = max(1, -(-size // BLOCK_BYTES), min(FEW_RANGES, size // LEAST_RANGE))
    counts = scratch.save(document_counts(blocks, ranges), "counts")
    signed = scratch.save(signatures(blocks, counts, n), "signatures")
    scratch.drop(blocks)
    scratch.drop(counts)
    # Rows without doc_id have nothing to be called by: each is its own.
    classes = scratch.save(signed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")).where("class_id is not null"), "classes")
    some = signed.where("weight is not null").join(classes.withColumnRenamed("class_id", "doc_id"), ["digest", "doc_id"]).where("alone > n")
    # Where rows share a doc_id, one of them is taken, with the counts of its own text.
    texts = scratch.save(some.select(F.col("doc_id").alias("doc"), F.col("n").alias("rows"), "buckets", "samples", *SET).dropDuplicates(["doc"]), "texts")
    components = linked(texts, n, scratch)
    scratch.drop(texts)
    named = classes.join(components.select(F.col("doc").alias("class_id"), "component"), "class_id", "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return signed.select("doc_id", "digest").join(named, "digest", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
