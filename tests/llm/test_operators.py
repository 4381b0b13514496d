"""Every operator against a plain computation over a small table, and over a table of odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlpit.llm import bpe, chat, components, cover_tree, line_dedup, minhash, mixing, quality, queries, sharding, token_store, toxicity
from marlpit.llm.common import Scratch

RANKS, PATTERN, WORDS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
BANNER = "This very line of more than forty characters is everywhere."
VOCABULARY = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def make_documents():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [text_of(rng, rng.randrange(3, 30)) + rng.choice([".", "", "!"]) for _ in range(rng.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([BANNER, "  " + BANNER.upper() + "\t"]))
        rows.append([i, "\n".join(lines), rng.choice(["a", "b", "c", None])])
    for i in range(60, 72):  # near copies: a word in about sixty is another
        words = rows[i - 60][1].split(" ") * 3
        words[rng.randrange(len(words))] = "other"
        rows.append([i, " ".join(words), "a"])
        rows.append([i + 100, " ".join(rows[i - 60][1].split(" ") * 3), "b"])
    rows += [[300, rows[1][1], "a"], [301, rows[1][1], "b"], [302, "é中文 naïve 👩‍👩‍👧  x  y\n\n z", None], [303, "", "c"], [304, None, "c"], [305, " \t\n", None], [306, text_of(rng, 4000), "a"], [307, "x" * 5000, "b"]]
    return rows


DOCUMENTS = make_documents()
SCHEMA = "doc_id long, text string, source string"
#: Odd rows: no id, no text, repeated rows, and columns named like results.
ODD = [(None, None, None, 1, "x"), (None, "a b c d e f", "s", 2, "y"), (5, None, "s", None, None), (5, "a b c d e f", None, 3, "z"), (5, "a b c d e f", None, 3, "z"), (6, "", "s", 4, ""), (7, "a b c d e f", "s", 5, ""), (8, "lang " * 3000, "", 6, "")]
ODD_SCHEMA = "doc_id long, text string, source string, size long, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([tuple(r) for r in DOCUMENTS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    more = {c: F.lit(1) for c in ("n_words", "kept", "ids", "n_tokens", "shard", "slot", "range", "target", "copies", "taken", "n_lines", "predicted", "passages", "class_id", "word", "bucket", "__x")}
    return spark.createDataFrame(ODD, ODD_SCHEMA).withColumns(more).repartition(3)


OPERATORS = {
    "quality": lambda d: quality.quality_rules(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "minhash": lambda d: minhash.near_duplicates(d),
    "shards": lambda d: sharding.balanced_shards(d),
    "mix": lambda d: mixing.mix(d),
    "bpe": lambda d: bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS, PATTERN),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, name):
    assert OPERATORS[name](odd).count() == len(ODD)
    assert OPERATORS[name](odd.where("doc_id > 1000")).count() == 0


def test_values_of_odd_rows(odd):
    """What the docstrings promise of rows without text, id or source, of repeated rows and of a very long text."""
    words = {None: 0, "": 0, "a b c d e f": 6, "lang " * 3000: 3000}
    sizes = sorted(words[r[1]] for r in ODD)
    mixed = mixing.mix(odd).collect()
    assert sorted((r["size"], r.source_size) for r in mixed) == sorted((words[r[1]], {None: 12, "s": 12, "": 3000}[r[2]]) for r in ODD)
    assert all(r.taken == r.copies * r["size"] and r.copies <= 2 and (r["size"] > 0 or r.taken == 0) for r in mixed)
    lines = line_dedup.dedup_lines(odd).collect()
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in lines) == sorted((r[1] or "", 1, 0) for r in ODD)
    rules = quality.quality_rules(odd).collect()
    assert sorted(r.n_words for r in rules) == sizes and all(r.base_failed and not r.kept for r in rules)
    shards = sharding.balanced_shards(odd, 4).collect()
    assert sorted((r["size"], r.text_crc32) for r in shards) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert {(r.shard, r.slot) for r in shards} == {(s, k) for s in range(4) for k in range(sum(r.shard == s for r in shards))}
    back = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in ODD) and sum(r.n_tokens == 0 for r in back) == sizes.count(0)
    scored = toxicity.score(odd, toxicity.fit(odd, odd.select("doc_id", F.lit(1).alias("toxic")))).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def test_odd_tables_in_the_token_store(spark, odd):
    for d, n in ((odd, len(ODD)), (odd.where("doc_id > 1000"), 0)):
        scratch = Scratch(spark, "t")
        token_store.write_store(d, scratch.root, WORDS_FILE, 2)
        assert token_store.read_store(spark, scratch.root).count() == n


# 1


def links_by_hand(rows, cosine):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _ in good}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                near[i].add(j)
    low = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            m = min([low[i], *(low[j] for j in js)])
            changed |= m < low[i]
            low[i] = m
    return {i: (len(near.get(i, ())), low[i]) for i in low}


def test_near_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 6] + 0.12 * rng.normal(size=8)).tolist()) for i in range(90)]
    rows += [(200 + i, (3 * base[0]).tolist()) for i in range(30)]
    rows += [(400, None), (401, [0.0] * 8), (402, [1.0, None] * 4), (403, [float("nan")] * 8), (404, [1.0, 2.0]), (405, [1.0, 2.0]), (406, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_pairs(df, 0.95).collect()}
    assert got == links_by_hand(rows, 0.95)
    assert cover_tree.near_pairs(df.where("vec_id > 1000")).count() == 0


def test_cover_tree_pairs_of_blocks():
    rng = np.random.default_rng(2)
    a = cover_tree.unit(np.concatenate([rng.normal(size=(3, 5))[rng.integers(0, 3, 300)] + 0.2 * rng.normal(size=(300, 5))]))
    tree = cover_tree.CoverTree(a)
    x, y = (np.concatenate(z) for z in zip(*cover_tree.dual_links(tree, tree, 0.95)))
    got = {tuple(sorted((int(tree.order[i]), int(tree.order[j])))) for i, j in zip(x, y)}
    assert len(got) == len(x)
    assert got == {(i, j) for i, j in np.argwhere(a @ a.T >= 0.95).tolist() if i < j}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    low = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(300):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "c")).collect()
    assert {r.id: r.component for r in got} == low and len(got) == len(low)


# 2


def test_bpe_equals_tiktoken(docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(out) == len(DOCUMENTS)
    for r in out:
        text = r.text or ""
        ids = own.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded).decode() == text
        _, starts = own.decode_with_offsets(ids) if ids else ("", [])
        assert np.frombuffer(r.char_starts, "<i4").tolist() == starts


def test_decoding_a_split_character(spark):
    codec = bpe.codec(RANKS, PATTERN)
    ids = codec.encode(["👩"])[0]
    assert len(ids) > 4 and codec.decode(ids).decode() == "👩" and codec.decode(ids[:4]) == "👩".encode()[: len(codec.decode(ids[:4]))]


# 3

HARD = ["\\### Assistant: </turn> ok", "</turn>\n### assistant: no", "a\\", "\\\\", "#", "", None, "👩 <", "\n\n", "$1 \\$2"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "as:sistant", "assistant", None, "user", "assistant"], HARD))] + [(2, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("examples", F.lit(1)).repartition(3)
    out = chat.format_conversations(df)
    back = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_losses(F.col("formatted"), F.col("examples")).alias("l")).collect()
    assert len(back) == 3
    for r in back:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == own
        assert r.l == [text for role, text in own if role == "assistant"]
    whole = {r.conv_id: r.formatted for r in out.collect()}
    examples = chat.expand_examples(out).collect()
    assert len(examples) == 8
    for e in examples:
        assert whole[e.conv_id].startswith(e.text) and e.text.endswith(chat.END) and e.loss_start + e.loss_chars + len(chat.END) == len(e.text)
    assert chat.format_conversations(df.where("turn > 99")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_chat_query_reads_its_examples(spark, monkeypatch):
    whole = {r.conv_id: r for r in queries.op3_chat_prefix_targets(spark, SF).collect()}
    expand = chat.expand_examples
    monkeypatch.setattr(chat, "expand_examples", lambda formatted: expand(formatted).where("example_no > 0"))
    less = {r.conv_id: r.n_examples for r in queries.op3_chat_prefix_targets(spark, SF).collect()}
    assert len(whole) > 10 and less == {c: max(r.n_examples - 1, 0) for c, r in whole.items()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    for r in turns.collect():
        loss = "".join(t.text or "" for t in r.t)
        assert (whole[r.conv_id].loss_chars, whole[r.conv_id].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# 4


def shingle_weights(text, df, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    tf = {}
    for s in [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []):
        tf[s] = tf.get(s, 0) + 1
    return {s: c * (1 + np.log(min(100, n / df[s])) / np.log(100)) for s, c in tf.items()} if df is not None else tf


def test_near_duplicates_equal_brute_force(spark, docs):
    n, df = len(DOCUMENTS), {}
    for _, text, _ in DOCUMENTS:
        for s in shingle_weights(text, None, 0):
            df[s] = df.get(s, 0) + 1
    sets = {i: shingle_weights(t, df, n) for i, t, _ in DOCUMENTS}
    low = {i: i for i in sets}

    def alike(a, b):
        if not a or not b:
            return not a and not b
        least = sum(min(w, b[s]) for s, w in a.items() if s in b)
        return least >= 0.8 * (sum(a.values()) + sum(b.values()) - least)

    text = {i: t or "" for i, t, _ in DOCUMENTS}
    pairs = [(i, j) for i in sets for j in sets if i < j and (text[i] == text[j] or (sets[i] and alike(sets[i], sets[j])))]
    assert len(pairs) >= 12
    for _ in range(5):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (low[i], low[i] == i) for i in low}


def test_counts_of_all_shingles_are_exact(spark, docs):
    df = {}
    for _, text, _ in DOCUMENTS:
        for s in shingle_weights(text, None, 0):
            df[s] = df.get(s, 0) + 1
    blocks = minhash.pack_documents(docs, block_bytes=1500).cache()
    held = {r.block: r for r in blocks.collect()}
    assert sum(r.rows for r in held.values()) == len(DOCUMENTS) and len(held) > 10
    got = {}
    for r in minhash.document_counts(blocks, 9).collect():
        got.setdefault(r.block, []).extend(minhash.unpack(r.df, np.uint32).tolist())
    for block, r in held.items():
        own = {s for t in minhash._opened(r.data)[1] for s in shingle_weights(t, None, 0)}
        assert sorted(got.get(block, [])) == sorted(df[s] for s in own)


def test_texts_that_cannot_have_a_partner():
    w = np.array([1.0, 1.0, 1.0, 1.0, 1.0, 5.0])
    assert minhash.lone_until(np.array([1, 1, 2, 9, 9, 9], dtype=np.uint32), w * 0 + 1) == 1
    assert minhash.lone_until(np.array([1, 1, 2, 9, 9, 9], dtype=np.uint32), w) == 2
    assert minhash.lone_until(np.array([3, 3, 3, 3, 3, 3], dtype=np.uint32), w) == 3


def test_a_large_group_of_near_copies(spark):
    # Copies of one text with so many words changed that some pairs are similar enough and others aren't.
    rng = random.Random(9)
    base = text_of(rng, 400).split(" ")
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(2, 9)):
            words[rng.randrange(400)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, text_of(rng, 60)) for i in range(250, 400)]
    df, n = {}, len(rows)
    for _, t in rows:
        for s in shingle_weights(t, None, 0):
            df[s] = df.get(s, 0) + 1
    sets = [{s: c * (1 + np.log(n / df[s]) / np.log(100)) for s, c in shingle_weights(t, None, 0).items()} for _, t in rows]
    total = [sum(s.values()) for s in sets]
    links = []
    for i in range(250):
        for j in range(i):
            least = sum(min(w, sets[j][s]) for s, w in sets[i].items() if s in sets[j])
            links += [(i, j)] * bool(least >= 0.8 * (total[i] + total[j] - least))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert 500 < len(links) < 250 * 249 // 2 and sum(found[i] == found[j] for i, j in links) >= 0.9 * len(links)
    assert all(found[i] == i for i in range(250, 400))


def test_shared_passage_weighs_less_than_rare_text(spark):
    rng = random.Random(5)
    passage = text_of(rng, 204)
    rows = [(i, passage + "".join(f" own{i}x{k}" for k in range(24))) for i in range(4)] + [(i, f"filler {i} has seven words of its own") for i in range(4, 400)]
    # With every count below 4 taken as 4, the similarity of the four would be 200 / 248.
    w = 1 + np.log(400) / np.log(100)
    assert 400 / (400 + 48 * w) < 0.79 and 200 / 248 > 0.8
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.where("not kept").isEmpty()


def test_driver_gets_no_shingles(spark, monkeypatch):
    # Forty copies of one text: every shingle of it is common, and was named to the driver.
    text = text_of(random.Random(6), 300)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(4)
    rows, kind = [], type(docs)
    collect, stream = kind.collect, kind.toLocalIterator

    def collected(self):
        rows.extend(out := collect(self))
        return out

    def streamed(self, *a, **b):
        out = list(stream(self, *a, **b))
        rows.extend(out)
        return iter(out)

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toLocalIterator", streamed)
    assert minhash.near_duplicates(docs).where("kept").count() == 1
    assert len(rows) < 40


def test_sampling_agrees_at_the_similarity():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.uniform(1, 3, 300), rng.uniform(1, 3, 300)
    sampler = minhash.Sampler(n=4000)
    (s, t), (u, v) = sampler(keys[:250], a[:250]), sampler(keys[50:], b[50:])
    j = minhash.weighted_jaccard(tuple(x[np.argsort(keys[:250])] for x in (keys[:250], a[:250])), tuple(x[np.argsort(keys[50:])] for x in (keys[50:], b[50:])))
    assert abs(((s == u) & (t == v)).mean() - j) < 0.03


# 5


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def lines_by_hand(rows):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                held.setdefault(key_of(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key_of(x), ())) < 5 or max(held[key_of(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()}
    expected = lines_by_hand([(i, t) for i, t, _ in DOCUMENTS])
    assert got == expected and sum(x[2] for x in got.values()) > 10


def test_line_references_can_be_deleted(spark, docs):
    refs = line_dedup.references(docs)
    some, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    back = line_dedup.delete(line_dedup.references(rest).union(line_dedup.references(some)), some)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, line_dedup.references(rest).collect()))
    before, after = line_dedup.frequent_keys(refs), line_dedup.frequent_keys(back)
    shards = 4
    filters = line_dedup.update_filters(line_dedup.filter_shards(before, shards), before.join(after, ["k1", "k2"], "left_anti"), after.join(before, ["k1", "k2"], "left_anti"), shards)
    assert filters.where("full").isEmpty()
    filters = filters.drop("full")
    again = line_dedup.update_filters(filters, after.limit(0), before.join(after, ["k1", "k2"], "left_anti"), shards).drop("full")
    held = line_dedup.probe(before.select("k1", "k2", F.lit(1).cast("long").alias("doc_id")), again, shards)
    assert held.count() == before.count() > 0
    assert line_dedup.probe(before.select("k1", "k2", F.lit(1).cast("long").alias("doc_id")), filters, shards).count() == after.count()


def test_line_index_after_changes(spark, docs):
    scratch = Scratch(spark, "lines")
    refs = scratch.save(line_dedup.references(docs), "references")
    some, rest = refs.where("doc_id % 2 = 0"), refs.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex(scratch, min_docs=3)
    index.apply(come=some)
    index.apply(come=rest)
    full = {tuple(r) for r in index.frequent.collect()}
    assert full == {tuple(r) for r in line_dedup.frequent_keys(refs, 3).collect()}
    index.apply(gone=some)
    left = {tuple(r) for r in index.frequent.collect()}
    assert left == {tuple(r) for r in line_dedup.frequent_keys(rest, 3).collect()} and len(left) < len(full)
    # The filters hold the keys that stay frequent and, fingerprints apart, no others.
    every = spark.createDataFrame(list(full), "k1 long, k2 long, n_docs long, keep_doc long").select("k1", "k2", F.lit(1).cast("long").alias("doc_id"))
    assert {(r.k1, r.k2) for r in line_dedup.probe(every, index.filters, index.shards).collect()} == {x[:2] for x in left}
    index.apply(come=some)
    assert {tuple(r) for r in index.frequent.collect()} == full


def held_keys(spark, index, keys):
    every = spark.createDataFrame([(a, b, 1) for a, b in keys], "k1 long, k2 long, doc_id long")
    return {(r.k1, r.k2) for r in line_dedup.probe(every, index.filters, index.shards).select("k1", "k2").collect()}


def test_line_index_that_overflows_with_clashing_fingerprints(spark):
    """Two keys of one shard and one fingerprint that share a bucket in a small filter, not in a large one: deleting one of them
    keeps the other, whatever filters were full in between."""
    mark, scratch = 7 << 48, Scratch(spark, "lines")
    a, b = (16, mark | 3), (32, mark | (3 + 8 * 5))
    refs = lambda keys: spark.createDataFrame([(k1, k2, 1) for k1, k2 in keys], "k1 long, k2 long, doc_id long")
    rng = np.random.default_rng(9)
    many = [(16 * int(x), int(y)) for x, y in rng.integers(1 << 20, 1 << 60, (900, 2)) // np.array([[64, 1]])]
    index = line_dedup.LineIndex(scratch, min_docs=1)
    index.apply(come=refs([a]))
    index.apply(come=refs([b, *many]))
    assert held_keys(spark, index, [a, b, *many]) == {a, b, *many} and index.filters.where("shard = 0").count() == 1
    index.apply(gone=refs([a]))
    assert b in held_keys(spark, index, [a, b]) and a not in held_keys(spark, index, [a, b])
    index.apply(gone=refs(many[:850]), come=refs([a]))
    index.apply(gone=refs([b]))
    assert held_keys(spark, index, [a, b, *many[850:]]) == {a, *many[850:]}


def test_line_index_deals_its_shards_anew_and_opens_again(spark, docs):
    scratch = Scratch(spark, "lines")
    refs = scratch.save(line_dedup.references(docs), "references")
    rng = np.random.default_rng(2)
    more = spark.createDataFrame([(int(x), int(y), 7) for x, y in rng.integers(-(1 << 62), 1 << 62, (3000, 2))], "k1 long, k2 long, doc_id long")
    index = line_dedup.LineIndex(scratch, min_docs=1, keys_per_shard=20)
    index.apply(come=more.limit(100))
    assert index.shards == 16
    index.apply(come=refs)
    index.apply(come=more.exceptAll(more.limit(100)))
    n = index.frequent.count()
    assert n > 3000 and index.shards == n // 20
    index.save(f"{scratch.root}/kept")
    opened = line_dedup.LineIndex.open(Scratch(spark, "lines"), f"{scratch.root}/kept")
    for i in (index, opened):
        i.apply(gone=refs)
    assert {tuple(r) for r in opened.frequent.collect()} == {tuple(r) for r in index.frequent.collect()} == {tuple(r) for r in line_dedup.frequent_keys(more, 1).collect()}
    some = [(r.k1, r.k2) for r in more.limit(50).collect()]
    assert held_keys(spark, opened, some) == set(some)


def test_line_dedup_in_batches_equals_one_insertion(docs):
    one = {tuple(r) for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert one == {tuple(r) for r in line_dedup.dedup_lines_in_batches(docs, min_docs=3, parts=3).collect()}


def test_cuckoo_filter_undoes_a_failed_insertion():
    full = line_dedup.CuckooFilter(np.arange(1, 17, dtype=np.uint16).reshape(4, 4))
    before = full.table.copy()
    assert not full.add(99, 1) and (full.table == before).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    made = line_dedup.CuckooFilter.built_from(k1, k2)
    assert made.contains(k1, k2).all()
    assert made.contains(k1 + 1, rng.integers(-(1 << 62), 1 << 62, 5000)).mean() < 0.01
    marks, buckets = made._places(k1, k2)
    assert all(made.discard(int(m), int(b)) for m, b in zip(marks, buckets)) and not made.table.any()


# 6


def test_balanced_shards(docs):
    out = sharding.balanced_shards(docs, 16).orderBy("doc_id").collect()
    size = {i: len((t or "").encode()) + 1 for i, t, _ in DOCUMENTS}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t, _ in DOCUMENTS}
    total, before, seen = sum(size.values()), 0, {}
    for r in out:
        assert r.shard == min(15, before * 16 // total)
        assert r.slot == seen.get(r.shard, 0)
        seen[r.shard], before = r.slot + 1, before + r.size
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}


# 7


def test_segments_are_all_maximal_ones():
    rng = random.Random(6)
    for _ in range(200):
        values = {f"w{i}": rng.choice([-1.0, -0.4, 0.5, 1.2]) for i in range(6)}
        words = [rng.choice([*values, "none"]) for _ in range(rng.randrange(14))]
        scores = [values.get(w, 0.0) - toxicity.DRIFT for w in words]

        def best(lo, hi):
            """The maximal segments of a stretch: its best segment, then those on both sides of it."""
            found = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if found[0] <= 1e-12:
                return []
            a = -found[2]
            b = a - found[1]
            return best(lo, a) + [(a, b)] + best(b, hi)

        got = toxicity.Model(weights=values).segments(words)
        assert [(a, b) for _, a, b in got] == best(0, len(words))
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for s, a, b in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op7_toxic_segments(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in out if a.toxic for b in out if not b.toxic]
    assert np.mean(pairs) >= 0.95


# 8


def quality_by_hand(text):
    body = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts(spark, docs):
    more = [(900, "a b c d e f g a b c d e f g h i j k l m n o p q r s", "a"), (901, "One line.\nOne line.\n\n\n#*| home | about | us |\nOne line.", "a")]
    rows = [*map(tuple, DOCUMENTS), *more]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, _ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_by_hand(text), i
        assert not (r.kept and r.base_failed)


def test_line_rules(spark):
    lines = {
        "A sentence that ends.": False, "No end of any sort": True, "Home | About | News | Contact.": True, "We value you. See our privacy policy.": True, "Long » text » with » many words in it, and so on and so on and more.": False,
        '"Quoted," he said, "and closed."': False, "": False, "# % & | .": True, "Buy!! Now!! Here!!": True,
    }
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", quality.line_fails(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == lines


def test_documents_that_lose_too_much_go(spark):
    good, bad = "These are five good words here. Others came in after them. ", "not one sentence end is in this line"
    rows = [(1, f"{good}\n{bad}"), (2, f"{good}\n{bad}\nand the same holds for this one too")]
    out = {r.doc_id: (r.kept, r.clean_text) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (True, good) and out[2][0] is False


# 9


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS_FILE)
    tokenizer.encode_special_tokens = True
    scratch = Scratch(spark, "t")
    token_store.write_store(docs, scratch.root, WORDS_FILE, 2)
    out = token_store.read_store(spark, scratch.root).orderBy("doc_id").collect()
    start = 0
    assert [r.doc_id for r in out] == sorted(i for i, *_ in DOCUMENTS)
    texts = {i: t or "" for i, t, _ in DOCUMENTS}
    for r in out:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.fetch(spark, scratch.root, 302)[-1] == 2
    for r in out[::9]:
        assert token_store.fetch(spark, scratch.root, r.doc_id) == np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert token_store.fetch(spark, scratch.root, 123_456) is None
    # The block is found without its payload, by statistics of its bounds.
    plan = token_store.blocks_of(spark, scratch.root, 302)
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in scan and "ReadSchema: struct<range:int,block:int,first_doc:bigint,last_doc:bigint>" in scan and "(first_doc,302)" in scan and plan.count() == 1
    dictionary = spark.read.parquet(f"{scratch.root}/dictionary").first()
    assert hashlib.sha256(bytes(dictionary.data)).hexdigest() == dictionary.sha256


def test_special_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endof text|>"]
    plain = Tokenizer.from_file(WORDS_FILE)
    own = token_store.WordEncoder(WORDS_FILE, 2)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_dictionary_learns_from_whole_documents(spark, monkeypatch):
    rows = [(1, text_of(random.Random(9), 50_000)), (2, "a b c"), (3, "")]
    seen = []
    monkeypatch.setattr(token_store.zstandard, "train_dictionary", lambda size, samples: seen.extend(samples) or token_store.zstandard.ZstdCompressionDict(b""))
    token_store.train_dictionary(spark.createDataFrame(rows, "doc_id long, text string"), WORDS_FILE, 2)
    whole = token_store.WordEncoder(WORDS_FILE, 2).encode([t for _, t in rows])
    assert len(whole[0]) > 2 * token_store.PIECE_BYTES
    assert sorted(seen) == sorted(w[i : i + token_store.PIECE_BYTES] for w in whole for i in range(0, len(w), token_store.PIECE_BYTES))


# 10


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2.0 * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    sizes = {}
    for i, text, source in DOCUMENTS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = targets_by_hand(sizes)
    assert len(out) == len(DOCUMENTS)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    for s in sizes:
        taken = sum(r.taken for r in out if r.source == s)
        assert abs(taken - target[s]) <= max(r.size for r in out if r.source == s and r.size < 1000)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def tilted_by_hand(sizes, target, max_rate=2.0):
    """Bisection on the multiplier of single documents, relative to one copy of each."""
    sizes = np.array(sizes, dtype=np.float64)
    rates = lambda m: max_rate / (1 + np.exp(-np.clip(m * sizes, -700, 700)))
    low, high = -100.0, 100.0
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if (rates(middle) * sizes).sum() < target else (low, middle)
    return middle, rates(middle)


def test_rates_are_tilted(spark):
    rng = random.Random(12)
    sizes = {"more": [rng.randrange(1, 900) for _ in range(60)], "fewer": [rng.randrange(1, 900) for _ in range(60)], "long": [3, 5, 8, 20_000], "full": [7, 7], None: [10, 100]}
    share = {"more": 1.6, "fewer": 0.3, "long": 1.1, "full": 2.0, None: 1.9}
    bins = spark.createDataFrame([(s, z, zs.count(z)) for s, zs in sizes.items() for z in set(zs)], "source string, size long, n long")
    targets = spark.createDataFrame([(s, sum(zs), share[s] * sum(zs)) for s, zs in sizes.items()], "source string, source_size long, target double")
    found = {r.source: r for r in mixing.solve_multipliers(bins, targets, Scratch(spark, "r")).collect()}
    rate = {(r.source, r.size): r.rate for r in mixing.tilted_rates(bins, targets, Scratch(spark, "r")).collect()}
    for s, zs in sizes.items():
        if s == "full":
            assert rate[s, 7] == 2.0
            continue
        mult, expected = tilted_by_hand(zs, share[s] * sum(zs))
        assert abs(found[s].mult / found[s].scale / mult - 1) < 1e-6 and found[s].mult * (share[s] - 1) > 0
        assert all(abs(rate[s, z] - e) < 1e-6 for z, e in zip(zs, expected))
        assert len({round(rate[s, z], 9) for z in zs}) > 1
    # more words than there are: long documents more often, and the other way round
    assert rate["more", max(sizes["more"])] > 1.5 > 1.2 > rate["more", min(sizes["more"])] > 1
    assert rate["fewer", max(sizes["fewer"])] < 0.5 < 0.9 < rate["fewer", min(sizes["fewer"])] < 1


def test_copies_follow_the_tilt(spark):
    frame = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 10).otherwise(100)).alias("text"), F.lit("s").alias("source"))
    mean = {r.size: r.c for r in mixing.mix(frame).groupBy("size").agg(F.avg("copies").alias("c")).collect()}
    _, expected = tilted_by_hand([10] * 300 + [100] * 300, 1.5 * 33_000)
    assert abs(mean[10] - expected[0]) < 0.05 and abs(mean[100] - expected[-1]) < 0.01 and mean[10] + 0.2 < mean[100]


# queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    from oracle import agree

    agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
