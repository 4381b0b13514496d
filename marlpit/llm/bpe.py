"""Byte-level BPE encoding and decoding over Arrow batches, from a file of ranks.

The tokenizers library merges; the ranks give its merges, and its byte table spells bytes as characters. A text is cut
before every space that follows a character other than white space: no match of the pattern crosses such a place, so the
pieces can be encoded one by one, and a worker keeps the ids of short pieces it has met, up to a fixed number. That holds
for patterns whose matches take at most one space, as their first character; others need a cut of their own. Under
GPT2_PATTERN a piece of Latin letters and closing punctuation is two matches, which go to the tokenizer's model as they are
spelled; the letters are kept on their own too, as they come with other endings. Decoding spells the ids in the
characters of the byte table and turns it around over the whole text, so that characters split over tokens come back whole; it
needs no tokenizer.

Defined results for odd input: a null or empty text has no tokens; repeated rows are encoded each on its own; other
columns pass through, except those named like the results; an empty table gives no rows; a very long text is encoded
whole. A worker holds one of Spark's Arrow batches, and the ids of SLICE documents of it at a time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 128
#: A worker keeps the ids of at most twice so many pieces, none longer than LONG characters.
MAX_PIECES, LONG = 75_000, 64
#: New pieces go to the tokenizer in texts of so many: longer ones take it more time a piece, and memory.
PIECES_A_TEXT = 500
#: The pattern whose matches in pieces of SIMPLE are its two groups, whatever stands around the piece.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
#: The special words of the GPT-2 byte table: these bytes stand for themselves, the others for characters from 256 on.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that spells each byte."""
    spare = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that the last merge of `token` joins: merge its bytes by ranks below its own until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank >= limit:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Speller:
    """The bytes of ids, by the tokens of a file of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        spell = byte_characters()
        self.spelled = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelled[rank] = "".join(spell[b] for b in token)
        #: From the character that spells a byte to the Latin-1 character of that byte.
        self.unspelled = {ord(c): b for b, c in enumerate(spell)}

    def decode(self, ids: bytes) -> bytes:
        """A character for each byte, whichever token it is of, and then the bytes."""
        return "".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).translate(self.unspelled).encode("latin-1")


class Codec(Speller):
    """A tokenizer made from ranks and a split pattern, and its cache of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        super().__init__(ranks)
        name = {t: self.spelled[r] for t, r in ranks.items()}
        merges = [(name[m[0]], name[m[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := merge_of(t, ranks))]
        self.tokenizer = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)]
        )
        self.n_bytes = np.array([len(t) for t in self.spelled], dtype=np.int64)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model if pattern == GPT2_PATTERN else None
        spell = byte_characters()
        self.spell = {c: "".join(spell[b] for b in chr(c).encode()) for c in range(256)}
        self.serial = [i.to_bytes(4, "little") for i in range(len(self.spelled))]
        self.odd = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S)(?= )")

    def split(self, text: str) -> list[str]:
        if "\0" in text or self.odd.search(text):
            return self.cut.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Known pieces are kept in two generations: a full one
        replaces the older one, and pieces met again move to the new one, so that frequent pieces stay."""
        cut = [self.split(t) if t else [] for t in texts]
        found = {p for pieces in cut for p in pieces}
        new = found.difference(self.pieces)
        if len(self.pieces) + len(new) > MAX_PIECES:
            self.older, self.pieces = self.pieces, {}
            new = found
        again = new & self.older.keys()
        self.pieces.update((p, self.older[p]) for p in again)
        self._learn([p for p in new - again if not self._simple(p)])
        get = self.pieces.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for p in [p for p in new if len(p) > LONG]:
            del self.pieces[p]
        if len(self.pieces) > MAX_PIECES:  # the slice alone has more
            self.older, self.pieces = {}, {}
        return out

    def _simple(self, piece: str) -> bool:
        """Whether the piece is of SIMPLE; then its ids are kept."""
        met = self.model and SIMPLE.fullmatch(piece)
        if not met:
            return False
        letters, tail = met.groups()
        self.pieces[piece] = self._match(letters) + self._match(tail) if tail else self._match(letters)
        return True

    def _match(self, text: str) -> bytes:
        """The ids of one match of the pattern."""
        ids = self.pieces.get(text) or self.older.get(text)
        if ids is None:
            spelled = text.replace(" ", self.spell[32]) if text.isascii() else text.translate(self.spell)
            ids = b"".join([self.serial[t.id] for t in self.model.tokenize(spelled)])
            if len(text) <= LONG:
                self.pieces[text] = ids
        return ids

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces; those that begin with a space and end in something else can stand in one text, each found again by offsets."""
        alone = [p for p in new if not (p[:1] == " " and p[-1] != " " and not p[-1].isspace())]
        for piece, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.pieces[piece] = np.array(e.ids, dtype="<u4").tobytes()
        run = [p for p in new if p[:1] == " " and p[-1] != " " and not p[-1].isspace()]
        for at in range(0, len(run), PIECES_A_TEXT):
            part = run[at : at + PIECES_A_TEXT]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ends = np.cumsum([len(p) for p in part])
            starts = np.array([s for s, _ in e.offsets], dtype=np.int64)
            ids = np.array(e.ids, dtype="<u4").tobytes()
            upto = 4 * np.searchsorted(starts, ends, side="left")
            before = 0
            for piece, end in zip(part, upto.tolist()):
                self.pieces[piece] = ids[before:end]
                before = end

    def character_starts(self, ids: bytes, text: str) -> tuple[bytes, int]:
        """The code point in which each token begins, as 32-bit integers, and how many tokens begin inside a character."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        place = np.cumsum(lead) - 1
        ends = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
        starts = ends - self.n_bytes[np.frombuffer(ids, "<u4")]
        return place[starts].astype("<i4").tobytes(), int((~lead[starts]).sum())


@lru_cache(2)
def speller(path: str) -> Speller:
    """One for each worker process."""
    return Speller(read_ranks(path))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(path, pattern)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True, decoded: str | None = None) -> DataFrame:
    """docs with ids (binary, unsigned 32-bit little-endian), n_tokens and, if asked for, char_starts (binary, 32-bit, a
    code point for each token) and n_split (tokens that begin inside a character), and a column with the bytes that the ids
    decode to. Decoding here, a task has one Python worker; encode() and then decode() has two."""
    added = [("ids", T.BinaryType()), ("n_tokens", T.LongType())] + [("char_starts", T.BinaryType()), ("n_split", T.LongType())] * offsets
    added += [(decoded, T.BinaryType())] * bool(decoded)
    source = docs.drop(*[n for n, _ in added])
    keep = source.columns
    schema = T.StructType(source.schema.fields + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = _texts(part.column(keep.index(text)))
                ids = own.encode(texts)
                out = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if offsets:
                    starts = [own.character_starts(i, t) if i else (b"", 0) for i, t in zip(ids, texts)]
                    out += [pa.array([s for s, _ in starts], pa.binary()), pa.array([n for _, n in starts], pa.int64())]
                if decoded:
                    out.append(pa.array([own.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids. They are UTF-8 again if the ids are those of a whole text. The pattern doesn't matter to it."""
    source = encoded.drop(to)
    at_ids = source.columns.index(ids)
    schema = T.StructType(source.schema.fields + [T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speller(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                back = [own.decode(i or b"") for i in part.column(at_ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)
