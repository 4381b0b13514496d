"""Data sources that stream files instead of loading them: members of speech archives, and the first bytes of files.

Both read through Arrow's file systems (local paths and the URIs that these know). The path may be a file or a folder."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file's head, and files that a partition of heads has.
HEAD_BYTES, FILES_EACH = 64, 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the file, or of all files in the folder, in order."""
    from pyarrow import fs

    system, inner = _open(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    whole = lambda p: p if "://" not in path else path.split("://")[0] + "://" + (p if p.startswith("/") else f"/{p}" if path.startswith("file") else p)
    return sorted((whole(f.path), f.size) for f in every)


@dataclass
class _Paths(InputPartition):
    paths: tuple


class ArchiveReader(DataSourceReader):
    """A partition for each archive. An archive is read once, from front to back; audio is passed over."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Paths((p,)) for p, _ in _files(self.path)] or [_Paths(())]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            system, inner = _open(path)
            with system.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                for member in tar:
                    parts = member.name.split("/")
                    subset = parts[1] if len(parts) >= 3 else None
                    if not member.isfile():
                        continue
                    if member.name.endswith(".trans.txt"):
                        for line in tar.extractfile(member):
                            key, _, text = line.decode().strip().partition(" ")
                            if key:
                                yield path, "text", key, subset, text
                    elif member.name.endswith(".flac"):
                        yield path, "audio", parts[-1].removesuffix(".flac"), subset, None
                    elif subset is not None:
                        yield path, "other", None, subset, None
                    tar.members = []  # a stream of members keeps none


class SpeechArchive(DataSource):
    """format("speech_archive"): a row for each line of a transcript and each audio file of tar archives."""

    @classmethod
    def name(cls) -> str:
        return "speech_archive"

    def schema(self) -> str:
        return "archive string, kind string, id string, subset string, text string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


class HeadReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        every = _files(self.path)
        return [_Paths(tuple(every[i : i + FILES_EACH])) for i in range(0, len(every), FILES_EACH)] or [_Paths(())]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path, length in partition.paths:
            system, inner = _open(path)
            with system.open_input_file(inner) as f:
                yield path, length, f.read(self.size)


class FileHeads(DataSource):
    """format("file_heads"): path, length and the first bytes (option bytes, 64) of every file. No more of a file is read."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options["path"], int(self.options.get("bytes", HEAD_BYTES)))


def read_heads(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> DataFrame:
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", size).load(path)


def read_speech_archive(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(archive, id, subset, text, has_audio): utterances of tar archives of transcripts (`id text` lines in *.trans.txt) and .flac
    files. An id without a transcript has a NULL text.

    strict: an archive that doesn't hold one subset alone, or an id with only one of text and audio, is an error."""
    spark.dataSource.register(SpeechArchive)
    rows = spark.read.format("speech_archive").load(path)
    of_text, of_audio = F.col("kind") == "text", F.col("kind") == "audio"
    found = rows.where("kind <> 'other'").groupBy("archive", "id").agg(F.max("subset").alias("subset"), F.max(F.when(of_text, F.col("text"))).alias("text"), F.max(of_audio).alias("has_audio"))
    if not strict:
        return found
    subsets = rows.groupBy("archive").agg(F.count_distinct("subset").alias("n"), F.array_join(F.array_sort(F.collect_set("subset")), ", ").alias("names"))
    lone = found.where("text is null or not has_audio").groupBy("archive").agg(F.count("*").alias("n_lone"), F.min("id").alias("lone"))
    met = found.join(subsets, "archive").join(lone, "archive", "left")
    wrong = F.when(F.col("n") != 1, F.concat(F.lit("one subset is expected in "), "archive", F.lit(", found: "), "names"))
    wrong = wrong.when(F.col("n_lone") > 0, F.concat(F.col("n_lone").cast("string"), F.lit(" utterances lack audio or text in "), "archive", F.lit(", the first: "), "lone"))
    # In the text, so that no column pruning takes the check away from who reads texts or counts rows.
    return met.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))).select("archive", "id", "subset", "text", "has_audio")
