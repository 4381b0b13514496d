"""Archives and heads are streamed: what is read of a file doesn't grow with it."""

import io
import tarfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from marlpit.functions import media
from marlpit.sources import archives


def make(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = body if isinstance(body, int) else len(body)
            tar.addfile(info, open("/dev/zero", "rb") if isinstance(body, int) else io.BytesIO(body))


GOOD = [("L/README", b"x"), ("L/dev/1/1.trans.txt", "1-0 one étwo\n\n1-1 three\n".encode()), ("L/dev/1/1-0.flac", b"x"), ("L/dev/1/1-1.flac", b"y"), ("L/dev/2/2.trans.txt", b"2-0 \n"), ("L/dev/2/2-0.flac", b"")]


def rows(df):
    return sorted((r.archive.rsplit("/", 1)[1], r.id, r.subset, r.text, r.has_audio) for r in df.collect())


def test_archives_of_a_folder(spark, tmp_path):
    make(tmp_path / "a.tar.gz", GOOD)
    make(tmp_path / "b.tar", [(n.replace("dev", "test"), b) for n, b in GOOD], "w")
    found = rows(archives.read_speech_archive(spark, f"file://{tmp_path}", strict=True))
    assert found == [(f"{a}", i, s, t, True) for a, s in (("a.tar.gz", "dev"), ("b.tar", "test")) for i, t in (("1-0", "one étwo"), ("1-1", "three"), ("2-0", ""))]
    assert spark.read.format("speech_archive").load(f"file://{tmp_path}").rdd.getNumPartitions() == 2


@pytest.mark.parametrize("extra,said", [(("L/dev/1/1-9.flac", b"z"), "1 utterances lack"), (("L/dev/3/3.trans.txt", b"3-0 words\n"), "1 utterances lack"), (("L/other/README.txt", b"-"), "dev, other")])
def test_strict_archives(spark, tmp_path, extra, said):
    make(tmp_path / "a.tar.gz", [*GOOD, extra])
    with pytest.raises(Exception, match=said):
        archives.read_speech_archive(spark, f"file://{tmp_path}/a.tar.gz", strict=True).collect()
    assert archives.read_speech_archive(spark, f"file://{tmp_path}/a.tar.gz").where("has_audio and text is not null").count() == 3


def test_memory_does_not_grow_with_the_archive(tmp_path):
    make(tmp_path / "big.tar", [("L/dev/1/1-0.flac", 96 << 20), *GOOD], "w")
    reader = archives.ArchiveReader(str(tmp_path / "big.tar"))
    (part,) = reader.partitions()
    tracemalloc.start()
    n = sum(1 for _ in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 7 and peak < 8 << 20


def test_heads(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.mp3").write_bytes(b"ID3" + b"\0" * 100_000)
    (tmp_path / "in/deep/b.txt").write_bytes(b"")
    (tmp_path / "in/c.mov").write_bytes(b"\0\0\0\x14ftypqt  ")
    heads = archives.read_heads(spark, f"file://{tmp_path}/in")
    out = {r.path.rsplit("/", 1)[1]: (r.length, r.n, r.c) for r in heads.select("path", "length", F.length("head").alias("n"), media.container(F.col("head")).alias("c")).collect()}
    assert out == {"a.mp3": (100_003, 64, "mp3"), "b.txt": (0, 0, None), "c.mov": (12, 12, "mov")}
    assert archives.read_heads(spark, f"file://{tmp_path}/in/a.mp3", 3).first().head == b"ID3"
    with pytest.raises(Exception, match="nowhere"):
        archives.read_heads(spark, f"file://{tmp_path}/nowhere").collect()
