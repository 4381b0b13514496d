"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import bpe, chat, cover_tree, divergence, fingerprint, line_dedup, minhash, mixing, quality, sharding, token_store, toxicity, whitening
from marlpit.llm.common import Scratch, read_table


def op1_cover_tree_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_pairs(read_table(spark, sf_dir, "embeddings"), cosine=0.95).select("vec_id", "n_links", "component_id", "kept")


def op2_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, offsets=True, decoded="decoded")
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op3_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(extra))
    back = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("turns"))
    # The losses are read from the examples themselves, a row for each; their contexts go no further.
    examples = chat.expand_examples(out)
    losses = examples.select("conv_id", "example_no", chat.unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss"))
    losses = losses.groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("example_no", "loss"))).alias("losses"))
    back = back.join(losses, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.coalesce(F.array_join("losses.loss", ""), F.lit(""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.when(F.col("losses").isNull(), 0).otherwise(F.size("losses")).cast("long").alias("n_examples"),
    )


#: role and text of each turn as the template has them; what is read back must equal the input.
OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, n, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(n, r)
), e as (
  select *, regexp_replace(text, '([\\#<])', '\\\1', 'g') as et, regexp_replace(role, '([\\#<:])', '\\\1', 'g') as er from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || er || ': ' || et || ' </turn>' || chr(10))) as bigint) as formatted_chars,
  count(*) filter (where role = 'assistant') as n_examples
from e group by conv_id
"""


def op4_weighted_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines_in_batches(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as keep_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, f.key is not null and k.doc_id <> f.keep_doc as dropped from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256 from j group by doc_id
"""


def op6_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"), n_shards=16)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def bucket(name: str):
        return F.crc32(F.col(name).cast("string").cast("binary")) % 5

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(bucket("doc_id") != 0).select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", F.coalesce(bucket("doc_id") == 0, F.lit(True)).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op8_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", *[c for c in quality.COLUMNS if c != "clean_text"])


OP8_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as id from documents),
w as (select id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words, string_split(body, chr(10)) as lines from d),
win as (select id, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5),
seen as (select win.id, i, count(*) over (partition by win.id, list_slice(words, i, i + 4)) as n from win join w using (id)),
cover as (select id, count(distinct p) as n from (select id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from seen where n > 1) group by id),
l as (select id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from w),
f as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
  regexp_matches(line, '[.!?:;…][''")\]»”’]*[\x20\x09-\x0D]*$') or regexp_matches(line, '[.!?][\x20\x09-\x0D]') as closed,
  len(regexp_extract_all(line, '[|<>»›]')) as bars, regexp_matches(lower(line), '{quality.BOILERPLATE}') as phrase,
  len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(regexp_extract_all(line, '!!')) as shouts from l),
v as (select *, n > 0 and (not closed or (bars >= 3 and bars * 3 >= n) or (n <= 30 and phrase) or symbols * 2 >= n or shouts * 2 >= n) as fails from f),
g as (select id, cast(count(*) filter (where fails) as bigint) as n_lines_removed, cast(coalesce(sum(n) filter (where not fails), 0) as bigint) as kept_words,
  count(*) filter (where n > 0) - count(distinct line) filter (where n > 0) as n_dup_lines from v group by id),
b as (select d.doc_id, cast(len(words) as bigint) as n_words, cast(length(list_aggregate(words, 'string_agg', '')) as bigint) as c,
  cast(len(regexp_extract_all(body, '[#*$%&|<>]')) as bigint) as n_symbols, n_dup_lines, coalesce(cover.n, 0) as n_repeat_words, n_lines_removed, kept_words
  from d join w using (id) join g using (id) left join cover using (id))
select doc_id, n_words, coalesce(c, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and kept_words >= 0.5 * n_words as kept, n_lines_removed, kept_words
from b
"""


def op9_dictionary_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    token_store.write_store(read_table(spark, sf_dir, "documents"), scratch.root, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, scratch.root).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=16, scale=64.0, shift=1_000_000)


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), min_docs=30, top=50)


OP12_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as body from documents),
w as (select id, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as n_lang from w group by lang, term having count(distinct id) >= 30),
v as (select lang, count(*) as n_terms, sum(n_lang) as total_lang from k group by lang),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by w.lang, w.source, w.term),
s as (select lang, source, sum(n) as total from c group by lang, source),
g as (select x.lang, x.source, coalesce(total, 0) as total, n_terms, total_lang from (select distinct lang, source from d) x left join s using (lang, source) left join v using (lang)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5) // (total + 5 * n_terms) as p, 1 + cast(1000000000 as hugeint) * (n_lang + 5) // (total_lang + 5 * n_terms) as q
  from g join k using (lang) left join c using (lang, source, term)),
f as (select lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by lang, a.source, b.source),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
"""


def op13_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cover_tree_near_pairs,
        op2_byte_bpe_round_trip,
        op3_chat_prefix_targets,
        op4_weighted_minhash_near_duplicates,
        op5_cuckoo_line_dedup,
        op6_prefix_sum_shards,
        op7_toxic_segments,
        op8_line_first_quality,
        op9_dictionary_token_store,
        op10_entropy_balanced_mix,
        op11_lobpcg_whitening,
        op12_source_divergence_audit,
        op13_chunk_fingerprints,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_chat_prefix_targets": OP3_SQL, "op5_cuckoo_line_dedup": OP5_SQL, "op8_line_first_quality": OP8_SQL, "op12_source_divergence_audit": OP12_SQL}
