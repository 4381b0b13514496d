"""Token ids in files: every document one zstandard frame under a shared dictionary, found by an offset index.

Format (two Parquet tables under one folder, so that any store Spark writes to will do):
  dictionary: sha256 (hex), id_bytes (2 or 4, unsigned little-endian ids), data (binary);
  blocks: range, block, first_doc and last_doc (least and largest id in it), dictionary_sha256, payload (frames end to end),
    index (array of doc_id, offset, length, n_tokens).
Blocks in order of (range, block) hold the documents in ascending order of doc_id. A document is read by cutting its
frame out of the payload; a reader refuses blocks whose dictionary hash isn't the dictionary's.

Defined results for odd input: a null or empty text has only the end id; null doc_ids come first; repeated rows are stored
each, in order of their frames; a very long text is one frame, in a block of its own; other columns aren't stored; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.llm.bpe import byte_characters
from marlpit.llm.common import shuffle_width
from marlpit.llm.sharding import order_ranges, range_offsets

SLICE = 256
#: A worker keeps the ids of at most twice so many words, none longer than LONG bytes.
MAX_WORDS, LONG = 300_000, 64
#: Words whose two groups are two tokens' worth on their own under the steps STEPS of a tokenizer: normal form and lower case
#: take them letter by letter, and its pattern cuts them there.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
STEPS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
#: Unknown words go to the tokenizer as texts of so many: longer ones take it more time a word.
WORDS_A_TEXT = 500
#: The dictionary is trained on the documents of lowest hash, so many at most, cut into pieces of so many bytes, and of these on
#: the pieces of lowest hash, so many at most; its size in bytes at most.
SAMPLE_DOCUMENTS, PIECE_BYTES, SAMPLE_PIECES, DICTIONARY_BYTES = 1500, 1 << 16, 2048, 112_640
BLOCK_BYTES, BLOCK_DOCUMENTS = 2 << 20, 4096
BLOCKS = "range int, block int, first_doc long, last_doc long, dictionary_sha256 string, payload binary, index array<struct<doc_id:bigint,offset:int,length:int,n_tokens:int>>"


class WordEncoder:
    """The tokenizers library, asked once for each word between ASCII white space, which no token of these tokenizers crosses."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model if self._has_steps() else None
        spell = byte_characters()
        self.spell = {c: "".join(spell[b] for b in chr(c).encode()) for c in range(256)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.serial = [i.to_bytes(self.kind.itemsize, "little") for i in range(max(vocab.values(), default=-1) + 1)]

    def _has_steps(self) -> bool:
        """Whether the tokenizer's steps are STEPS, and none of its added tokens can stand in a word of SIMPLE."""
        own = json.loads(self.tokenizer.to_str())
        normal, pre, model = own["normalizer"] or {}, own["pre_tokenizer"] or {}, own["model"]
        same = (normal.get("normalizers"), pre.get("pretokenizers")) == STEPS and model["type"] == "BPE" and not model["dropout"] and not own["truncation"] and not own["padding"]
        return same and all(re.search("[^A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ]", t["content"]) for t in own["added_tokens"])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The serialized ids of texts. Known words are kept in two generations of MAX_WORDS each: a full one replaces the older one,
        and words met again move to the new one, so that frequent words stay."""
        cut = [t.encode().split() for t in texts]
        missing = {w for part in cut for w in part}.difference(self.words)
        if len(self.words) + len(missing) > MAX_WORDS:
            self.older, self.words = self.words, {}
            missing = {w for part in cut for w in part}
        again = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self._learn([w for w in missing - again if not self._simple(w)])
        get = self.words.__getitem__
        out = [b"".join(map(get, part)) + self.end for part in cut]
        for w in missing:
            if len(w) > LONG:
                del self.words[w]
        return out

    def _simple(self, word: bytes) -> bool:
        """Whether the word is of SIMPLE; then its ids are kept, and those of its letters, which come with other endings too."""
        met = self.model and SIMPLE.fullmatch(word.decode())
        if not met:
            return False
        letters, tail = met.groups()
        self.words[word] = self._match(letters.lower()) + self._match(tail) if tail else self._match(letters.lower())
        return True

    def _match(self, text: str) -> bytes:
        """The ids of one match of the tokenizer's pattern, in lower case."""
        key = text.encode()
        ids = self.words.get(key) or self.older.get(key)
        if ids is None:
            ids = b"".join([self.serial[t.id] for t in self.model.tokenize(text if text.isascii() else text.translate(self.spell))])
            if len(key) <= LONG:
                self.words[key] = ids
        return ids

    def _learn(self, new: list[bytes]) -> None:
        """Many words in one text, told apart by the offsets of their tokens."""
        for at in range(0, len(new), WORDS_A_TEXT):
            words = [w.decode() for w in new[at : at + WORDS_A_TEXT]]
            e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.array([s for s, _ in e.offsets], dtype=np.int64)
            ids = np.array(e.ids, dtype=self.kind).tobytes()
            before = 0
            for word, upto in zip(new[at : at + WORDS_A_TEXT], (self.kind.itemsize * np.searchsorted(starts, ends, side="left")).tolist()):
                self.words[word] = ids[before:upto]
                before = upto


@lru_cache(2)
def encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


@lru_cache(2)
def _zstd(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary, serialized). The end id closes every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = own.encode(pc.fill_null(part.column(1), "").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from at most SAMPLE_DOCUMENTS documents of lowest hash; empty if these are too few to train on.

    Their ids are chosen first, on doc_id alone, and only their texts go further, one for each doc_id.
    Their ids are cut into pieces of PIECE_BYTES. All pieces are taken, or the SAMPLE_PIECES of lowest hash if there are more:
    they come from any part of a document, and are at most 128 MiB on the driver."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    ids = encode_ids(few, path, end_id).select("doc_id", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("ids") - 1) / PIECE_BYTES).cast("int"))).alias("piece"))
    pieces = ids.select("doc_id", "piece", F.substring("ids", F.col("piece") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("ids"))
    pieces = pieces.orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids").limit(SAMPLE_PIECES)
    samples = [bytes(r.ids) for r in pieces.toLocalIterator()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Writes the two tables of the format to folder."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    kind = encoder(path, end_id).kind
    spark.createDataFrame([(sha, kind.itemsize, dictionary)], "sha256 string, id_bytes int, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    width = kind.itemsize

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = encoder(path, end_id), _zstd(dictionary)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = own.encode(pc.fill_null(part.column(2), "").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([press.compress(i) for i in ids], pa.binary()), pa.array([len(i) // width for i in ids], pa.int32())], names=["range", "doc_id", "frame", "n_tokens"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of range and doc_id; a block ends with its range, or when it is full."""
        schema = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dictionary_sha256", pa.string()), ("payload", pa.binary()), ("index", pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("n_tokens", pa.int32())])))])
        now, number, frames, index, size = None, 0, [], [], 0

        def block() -> pa.RecordBatch:
            ids = [x["doc_id"] for x in index if x["doc_id"] is not None]
            return pa.RecordBatch.from_pylist([{"range": now, "block": number, "first_doc": min(ids, default=None), "last_doc": max(ids, default=None), "dictionary_sha256": sha, "payload": b"".join(frames), "index": index}], schema=schema)

        for batch in batches:
            for rng, doc, frame, n in zip(*(c.to_pylist() for c in batch.columns)):
                if frames and (rng != now or size + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCUMENTS):
                    yield block()
                    number, frames, index, size = number + 1, [], [], 0
                if rng != now:
                    now, number = rng, 0
                index.append({"doc_id": doc, "offset": size, "length": len(frame), "n_tokens": n})
                frames.append(frame)
                size += len(frame)
        if frames:
            yield block()

    tasks = shuffle_width(spark)
    ranged = order_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", min(2000, 8 * tasks)).select("range", "doc_id", "text")
    frames = ranged.mapInArrow(shrink, "range int, doc_id long, frame binary, n_tokens int")
    ordered = frames.repartition(tasks, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "frame")
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, int, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.data)
    if hashlib.sha256(data).hexdigest() != row.sha256:
        raise ValueError("the dictionary isn't the one whose hash it carries")
    return row.sha256, row.id_bytes, data


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary, 32-bit) from the files."""
    sha, width, dictionary = _dictionary(spark, folder)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = blocks.select("range", "block", F.aggregate("index", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("tokens"))
    in_range = Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = totals.withColumn("inside", F.coalesce(F.sum("tokens").over(in_range), F.lit(0))).join(range_offsets(totals, before="tokens"), "range")
    at = at.select("range", "block", (F.col("before") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = _zstd(dictionary)[1]
        kind = np.dtype("<u2" if width == 2 else "<u4")
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(1)[k].as_py() != sha:
                    raise ValueError("a block was written with another dictionary")
                start, payload, index = batch.column(0)[k].as_py(), batch.column(2)[k].as_buffer(), batch.column(3)[k].as_py()
                view = memoryview(payload)
                for part in (index[i : i + SLICE] for i in range(0, len(index), SLICE)):
                    ids = [np.frombuffer(unpress.decompress(view[x["offset"] : x["offset"] + x["length"]]), kind).astype("<u4").tobytes() for x in part]
                    n = np.array([len(i) // 4 for i in ids], dtype=np.int64)
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["doc_id"] for x in part], pa.int64()), pa.array(starts), pa.array(n), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    placed = blocks.join(at, ["range", "block"]).select("start", "dictionary_sha256", "payload", "index")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def blocks_of(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """(range, block) of the blocks that a document can be in: of all others not even the statistics pass the filter, and payloads aren't read."""
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("range", "block")


def fetch(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """The ids of one document, None if there is none: its block is found by its bounds, then that block alone is read and one
    frame decompressed."""
    sha, width, dictionary = _dictionary(spark, folder)
    for at in blocks_of(spark, folder, doc_id).collect():  # one; more where an id was stored often
        block = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where((F.col("range") == at.range) & (F.col("block") == at.block))
        rows = block.select("dictionary_sha256", "payload", F.explode("index").alias("x")).where(F.col("x.doc_id") == doc_id)
        row = rows.select("dictionary_sha256", F.expr("substring(payload, x.offset + 1, x.length)").alias("frame")).first()
        if row:
            if row.dictionary_sha256 != sha:
                raise ValueError("a block was written with another dictionary")
            return np.frombuffer(_zstd(dictionary)[1].decompress(bytes(row.frame)), "<u2" if width == 2 else "<u4").tolist()
    return None
