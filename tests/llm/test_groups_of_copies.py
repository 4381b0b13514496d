"""Near copies of a text that has many copies: these make its shingles common, and must not hide the near copies."""

import random

import numpy as np
from marlpit.llm import minhash
from marlpit.llm.common import Scratch

DOCS = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def as_set(text, df, n):
    own = text.split(" ")
    tf = {}
    for s in [tuple(own[i : i + 5]) for i in range(len(own) - 4)]:
        tf[s] = tf.get(s, 0) + 1
    return {s: c * (1 + np.log(n / df[s]) / np.log(100)) if df else c for s, c in tf.items()}


def similarity(a, b):
    least = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


def counts(texts):
    df = {}
    for t in texts:
        for s in as_set(t, None, 0):
            df[s] = df.get(s, 0) + 1
    return df


def test_near_copies_of_a_text_with_many_copies_are_found(spark):
    rng = random.Random(2)
    base = words(rng, 400)
    texts = [" ".join(base)] * 60
    for k in range(12):
        near = list(base)
        for at in range(20 + k, 400, 45)[:8]:
            near[at] = f"own{k}x{at}"
        texts.append(" ".join(near))
    texts += [" ".join(words(rng, 20)) for _ in range(300)]
    df = counts(texts)
    for t in texts[60:72]:
        assert similarity(as_set(t, None, 0), as_set(texts[0], None, 0)) > 0.81
        assert similarity(as_set(t, df, len(texts)), as_set(texts[0], df, len(texts))) < 0.79
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 0 if i < 72 else i for i in range(len(texts))}


def test_a_passage_of_others_keeps_its_low_weight_towards_copies(spark):
    rng = random.Random(5)
    passage = " ".join(words(rng, 204))
    texts = [passage + "".join(f" own{i}x{k}" for k in range(24)) for i in (0, 0, 1, 2, 3)] + [f"filler {i} has seven words of its own" for i in range(395)]
    assert similarity(as_set(texts[0], None, 0), as_set(texts[2], None, 0)) > 0.8
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4))
    assert [r.doc_id for r in out.where("not kept").collect()] == [1]


def test_needed_is_the_least_number():
    rng = np.random.default_rng(4)
    n, got = 1000, []
    for _ in range(300):
        df = dict(enumerate(rng.integers(1, rng.integers(2, 400), 80).tolist()))
        tf = rng.integers(1, 3, 80)
        sets = [{int(k): int(tf[k]) for k in np.flatnonzero(rng.random(80) < share)} for share in (0.93, 0.9)]
        sides = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)], dtype=float), np.array([df[k] for k in sorted(x)], dtype=np.uint32)) for x in sets]

        def alike(d):
            return similarity(*({k: c * (1 + np.log(n / (1 if df[k] <= d else df[k])) / np.log(100)) for k, c in x.items()} for x in sets)) >= minhash.THRESHOLD

        expected = next((d for d in range(401) if alike(d)), None)
        got.append(minhash.needed(*sides, n))
        assert got[-1] == expected
    assert None in got and 0 in got and any(got)


def test_links_wait_until_a_group_is_large_enough(spark):
    links = spark.createDataFrame([(0, 1, 0), (1, 2, 4), (2, 3, 6), (3, 4, 9), (5, 6, 2), (7, 8, 6)], "a long, b long, needed long")
    rows = spark.createDataFrame([(i, 3 if i == 8 else 1) for i in range(9)], "doc long, rows long")
    out = minhash.grouped(links, rows, Scratch(spark, "test")).collect()
    assert {(r.doc, r.component) for r in out} == {(0, 0), (1, 0), (2, 0), (3, 0), (7, 7), (8, 7)}
