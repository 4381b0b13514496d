"""Texts under a crowded key of near-duplicate search: no link between two of them is lost."""

import random

import numpy as np
import pyarrow as pa
from marlpit.llm import minhash
from marlpit.llm.common import Scratch


def signed_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    blocks = scratch.save(minhash.pack_documents(docs), "blocks")
    signed = minhash.signatures(blocks, minhash.document_counts(blocks, 3), len(texts)).where("weight is not null")
    return scratch.save(signed.selectExpr("doc_id as doc", "weight", "buckets", "samples", *minhash.SET), "texts"), scratch


def test_links_of_a_crowded_key_are_joined(spark):
    rng = random.Random(1)
    common = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(240):
        words = list(common)
        for at in rng.sample(range(300), rng.randint(1, 4)):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    table, scratch = signed_texts(spark, texts)
    rows = table.collect()
    sets = {r.doc: minhash._opened_set(r.shingles, r.tf, r.df, len(texts)) for r in rows}
    keys = {r.doc: set(r.buckets) for r in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and keys[a] & keys[b] and minhash.weighted_jaccard(sets[a], sets[b]) >= minhash.THRESHOLD]
    component = {r.doc: r.component for r in minhash.linked(table, len(texts), scratch).collect()}
    assert len(linked) > 500 and all(a in component and component[a] == component.get(b) for a, b in linked)


def test_rounds_without_leaders_lose_nothing(spark, monkeypatch):
    """With one leader the rounds leave much; what they leave is compared whole."""
    monkeypatch.setattr(minhash, "LEADERS", 1)
    monkeypatch.setattr(minhash, "GROUP", 16)
    monkeypatch.setattr(minhash, "FEATURES", 50)
    test_links_of_a_crowded_key_are_joined(spark)


def test_block_similarities_are_those_of_pairs(spark):
    texts = ["a b c d e f g h", "a b c d e a b c d e a b c d e", "a b c d e f x a b c d e f", "q", "q r s t u v w"]
    table, _ = signed_texts(spark, [f"{t} {'z ' * 7}" for t in texts for _ in range(2)] + texts)
    rows = table.orderBy("doc").collect()
    packed = pa.table({c: pa.array([bytes(r[c]) for r in rows], pa.binary()) for c in minhash.SET})
    n = 2 * len(texts) + len(texts)
    sets = [minhash._opened_set(r.shingles, r.tf, r.df, n) for r in rows]
    expected = [[minhash.weighted_jaccard(a, b) for b in sets] for a in sets]
    assert rows and np.allclose(minhash.block_similarities(packed, packed, n), expected, atol=1e-9)
