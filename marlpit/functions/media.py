"""What a media file is, from its first bytes, and what a probe of it says, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 64
#: The type under which a container is stored as video and as audio; None: not accepted as such.
MIME_TYPES = {
    "mp4": ("video/mp4", "audio/mp4"),
    "mov": ("video/quicktime", None),
    "m4a": (None, "audio/mp4"),
    "webm": ("video/webm", "audio/webm"),
    "mkv": ("video/x-matroska", None),
    "mp3": (None, "audio/mpeg"),
    "wav": (None, "audio/wav"),
    "ogg": (None, "audio/ogg"),
}


def container(head: Column) -> Column:
    """The container that a file's first HEAD_BYTES bytes tell, NULL where they tell none. Names and claimed types don't count.

    Bytes are looked at as Latin-1 characters, one each."""
    s = F.decode(F.substring(head, 1, HEAD_BYTES), "ISO-8859-1")
    brand, long = F.substring(s, 9, 4), F.length(s) >= 12
    return (
        F.when(long & (F.substring(s, 5, 4) == "ftyp"), F.when(brand == "qt  ", "mov").when(brand.isin("M4A ", "M4B "), "m4a").otherwise("mp4"))
        .when(F.startswith(s, F.lit("\x1aE\xdf\xa3")), F.when(F.contains(s, F.lit("webm")), "webm").otherwise("mkv"))
        .when(F.startswith(s, F.lit("ID3")) | s.rlike(r"^\x{FF}[\x{E0}-\x{FF}]"), "mp3")
        .when(long & F.startswith(s, F.lit("RIFF")) & (brand == "WAVE"), "wav")
        .when(F.startswith(s, F.lit("OggS")), "ogg")
    )


def mime_type(container_name: Column, kind: Column) -> Column:
    """The type under which a container is stored that was handed in as `kind` ('video', else audio), NULL where it isn't accepted."""
    pairs = [x for name, (video, audio) in MIME_TYPES.items() for k, mime in ((f"{name}/video", video), (f"{name}/audio", audio)) if mime for x in (F.lit(k), F.lit(mime))]
    return F.try_element_at(F.create_map(*pairs), F.concat(container_name, F.when(kind == "video", "/video").otherwise("/audio")))


def probe_record(output: Column) -> Column:
    """A struct from the JSON of a media probe, NULL where it isn't a JSON object: the first audio stream, the first video stream
    that isn't a cover, and the duration of the file or else of the audio."""
    v = F.try_parse_json(output)
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    streams = F.coalesce(get(v, "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    audio = F.get(F.filter(streams, lambda s: F.coalesce(get(s, "$.codec_type", "string") == "audio", F.lit(False))), 0)
    is_cover = lambda s: F.coalesce(get(s, "$.disposition.attached_pic", "int"), F.lit(0)) != 0
    video = F.get(F.filter(streams, lambda s: F.coalesce(get(s, "$.codec_type", "string") == "video", F.lit(False)) & ~is_cover(s)), 0)
    duration = F.coalesce(F.nullif(get(v, "$.format.duration", "string"), F.lit("")), get(audio, "$.duration", "string"))
    record = F.struct(
        duration.try_cast("double").alias("duration_seconds"),
        get(v, "$.format.format_name", "string").alias("format"),
        audio.isNotNull().alias("has_audio"),
        video.isNotNull().alias("has_video"),
        get(audio, "$.codec_name", "string").alias("audio_codec"),
        get(audio, "$.sample_rate", "string").try_cast("int").alias("sample_rate"),
        get(audio, "$.channels", "int").alias("channels"),
        get(video, "$.codec_name", "string").alias("video_codec"),
    )
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), record)
