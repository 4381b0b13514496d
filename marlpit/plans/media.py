"""Media files and experiment records: containers from first bytes, probe records, hashes of canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import canonical, media
from marlpit.sources import tables as t

#: First bytes in hexadecimal that files begin with here; the document's text follows.
HEADS = [
    "000000206674797069736F6D", "000000146674797071742020", "00000020667479704D344120", "1A45DFA3000000007765626D", "1A45DFA36D6174726F736B61", "494433", "FFFB",
    "524946462400000057415645", "4F676753", "", "00000020667479704D344220", "FF1F",
]


def container_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the container that their first bytes tell, and the type they are stored under as video or audio."""
    d = t.table(spark, sf_dir, "documents")
    begin = F.unhex(F.get(F.array(*map(F.lit, HEADS)), F.pmod("doc_id", F.lit(len(HEADS))).cast("int")))
    found = media.container(F.concat(begin, F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    kind = F.when(F.col("doc_id") % 5 < 2, "video").otherwise("audio")
    return d.select("doc_id", found.alias("container"), kind.alias("kind")).withColumn("mime", media.mime_type(F.col("container"), F.col("kind")))


def _probe_json(cut: str, text: str) -> str:
    """SQL of both engines for what a probe prints about a document; cut is the text without its end."""
    cover = '{"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}}'
    audio = '{"codec_type":"audio","codec_name":"aac","sample_rate":"44100","channels":2'
    return f"""case doc_id % 6
      when 0 then concat('{{"format":{{"duration":"', {text}, '","format_name":"mov,mp4"}},"streams":[{cover},{audio}}},{{"codec_type":"video","codec_name":"h264"}}]}}')
      when 1 then concat('{{"format":{{}},"streams":[{audio},"duration":"', {text}, '"}},{{"codec_type":"audio","codec_name":"mp3","channels":1}}]}}')
      when 2 then concat('{{"format":{{"duration":', {text}, '}}}}')
      when 3 then {cut}
      when 4 then '[{{"codec_type":"audio"}}]'
      else '{{"format":{{"duration":"N/A"}},"streams":[{cover},{{"codec_type":"data"}}]}}' end"""


def probe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probes print about documents as files, as typed records; broken output gives none."""
    printed = F.expr(_probe_json("concat('{\"streams\":[', lang)", "cast(n_chars / 8 as decimal(12, 3))"))
    return t.table(spark, sf_dir, "documents").select("doc_id", media.probe_record(printed).alias("p")).select("doc_id", F.col("p").isNotNull().alias("readable"), "p.*")


def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each document, hashed without its id and time, and with its fields in another order."""
    d = t.table(spark, sf_dir, "documents")
    fields = {
        "run_id": F.uuid(), "created_at": F.lit("now"), "note": F.substring("text", 1, 30), "frozen": F.col("doc_id") % 2 == 0, "dataset": F.struct(F.col("lang").alias("kind"), F.col("doc_id").alias("id")),
        "retrieval": F.struct((F.pmod("doc_id", F.lit(7))).alias("top_k"), (F.col("n_chars") / 1000).alias("min_similarity")), "lectures": F.array(F.struct(F.col("source").alias("asr"), F.lit(None).cast("long").alias("words"))),
    }
    made = d.select("doc_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("one"), F.struct(*[c.alias(n) for n, c in reversed(fields.items())]).alias("other"))
    one, other = (canonical.canonical_hash(F.col(c), made.schema[c].dataType, ("run_id", "created_at")) for c in ("one", "other"))
    return made.select("doc_id", one.alias("config_hash"), (one == other).alias("order_is_nothing"))


_HEAD_LIST = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
_MIMES = "(values " + ", ".join(f"('{n}', '{k}', '{m}')" for n, pair in media.MIME_TYPES.items() for k, m in zip(("video", "audio"), pair) if m) + ") m(container, kind, mime)"
ORACLE_SQL = {
    "container_sniff": f"""with b as (select doc_id, case when doc_id % 5 < 2 then 'video' else 'audio' end as kind, substr(({_HEAD_LIST})[doc_id % {len(HEADS)} + 1] || hex(encode(coalesce(text, ''))), 1, 128) as h from documents),
      c as (select doc_id, kind, case when length(h) >= 24 and substr(h, 9, 8) = '66747970' then case substr(h, 17, 8) when '71742020' then 'mov' when '4D344120' then 'm4a' when '4D344220' then 'm4a' else 'mp4' end
        when starts_with(h, '1A45DFA3') then case when regexp_matches(h, '^(..)*7765626D') then 'webm' else 'mkv' end when starts_with(h, '494433') or regexp_matches(h, '^FF[EF]') then 'mp3'
        when length(h) >= 24 and starts_with(h, '52494646') and substr(h, 17, 8) = '57415645' then 'wav' when starts_with(h, '4F676753') then 'ogg' end as container from b)
      select doc_id, c.container, c.kind, mime from c left join {_MIMES} on m.container = c.container and m.kind = c.kind""",
    "probe_records": f"""with j as (select doc_id, {_probe_json("concat('{\"streams\":[', lang)", "cast(n_chars / 8 as decimal(12, 3))")} as j from documents),
      v as (select doc_id, case when json_valid(j) and json_type(j) = 'OBJECT' then cast(j as json) end as j from (select doc_id, case when json_valid(j) then j end as j from j)),
      s as (select doc_id, j, coalesce(json_extract(j, '$.streams[*]'), []) as s from v),
      a as (select doc_id, j, list_filter(s, lambda x: x->>'$.codec_type' = 'audio')[1] as a, list_filter(s, lambda x: x->>'$.codec_type' = 'video' and coalesce(cast(x->>'$.disposition.attached_pic' as integer), 0) = 0)[1] as v from s)
      select doc_id, j is not null as readable, try_cast(coalesce(nullif(j->>'$.format.duration', ''), a->>'$.duration') as double) as duration_seconds, j->>'$.format.format_name' as format,
      case when j is not null then a is not null end as has_audio, case when j is not null then v is not null end as has_video, a->>'$.codec_name' as audio_codec, try_cast(a->>'$.sample_rate' as integer) as sample_rate,
      try_cast(a->>'$.channels' as integer) as channels, v->>'$.codec_name' as video_codec from a""",
    "config_hashes": """select doc_id, sha256('{"dataset": {"id": ' || doc_id || ', "kind": ' || to_json(lang) || '}, "frozen": ' || (doc_id % 2 = 0) || ', "lectures": [{"asr": ' || to_json(source) || ', "words": null}], "note": ' || to_json(substr(text, 1, 30))
      || ', "retrieval": {"min_similarity": ' || cast(n_chars / 1000 as varchar) || ', "top_k": ' || (doc_id % 7) || '}}') as config_hash, true as order_is_nothing from documents""",
}
QUERIES = {f.__name__: f for f in (container_sniff, probe_records, config_hashes)}
