"""Whitening, the divergence audit and fingerprints against plain computations, and over odd rows."""

import hashlib
import random
import re
from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import divergence, fingerprint, whitening
from marlpit.llm.common import Scratch

CLASH = ("dim", "x", "n", "component", "deviation", "term", "docs", "sid", "p0", "item", "rank", "part", "value", "hash", "range", "tail", "hot", "fingerprint", "n_chars", "__to", "__of", "__id")


def clashing(frame):
    return frame.withColumns({c: F.lit("x") for c in CLASH})


# 11


def whitened_by_hand(rows, components=16):
    good = [(i, np.array([floor(64 * float(c)) + 1_000_000 for c in v], dtype=np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in good}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1], c[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    return [(i, int(((x * n - sums).astype(object) ** 2).sum()), (x * n - sums) / n @ (c[:, :k] / np.sqrt(e[:k]))) for i, x in good], e[:k] / e.sum(), n


@pytest.mark.parametrize("dim,rows,rank", [(40, 300, 40), (90, 500, 90), (6, 50, 3), (20, 12, 20)])
def test_whitening_equals_a_dense_solver(spark, dim, rows, rank):
    rng = np.random.default_rng(dim)
    mixed = rng.normal(size=(rows, rank)) * np.linspace(4, 0.5, rank)
    data = (mixed @ rng.normal(size=(rank, dim))).round(3) if rank == dim else np.repeat(mixed.round(1), 2, axis=1)
    table = [(i, v.tolist()) for i, v in enumerate(data)] + [(rows + i, data[0].tolist()) for i in range(40)]
    table += [(9001, None), (9002, [float("nan")] + [0.5] * (dim - 1)), (9003, [None] + [0.5] * (dim - 1)), (9004, [float("inf")] * dim), (9005, []), (9006, [1.0])]
    expected, explained, n = whitened_by_hand([t for t in table if t[0] != 9006])
    frame = clashing(spark.createDataFrame(table, "vec_id long, embedding array<double>")).repartition(7)
    out = whitening.whiten(frame).collect()
    k = len(explained)
    assert len(out) == len(expected) * k and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, k + 1))
    at = {(r.vec_id, r.component): r for r in out}
    sign = [np.sign(sum(e[2][c] * at[e[0], c + 1].whitened for e in expected)) for c in range(k)]
    for i, deviation, white in expected:
        for c in range(k):
            r = at[i, c + 1]
            assert r.deviation == deviation and abs(r.whitened * sign[c] - white[c]) < 1e-7 and abs(r.explained / explained[c] - 1) < 1e-9
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9 and max(r.residual for r in out) < 1e-10


def test_whitening_iterates_beyond_its_block(spark):
    """A dimension far above three blocks, so that the search space isn't everything."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 200)) * np.linspace(9, 0.3, 200) / 8
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    model = whitening.fit(whitening.grid_rows(frame), Scratch(spark, "w"), components=5, guard=3)
    x = np.floor(64 * data)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert model.steps > 4 and np.allclose(model.values, e[:5], rtol=1e-12) and model.residuals.max() < 1e-10


def test_whitening_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(frame.where("vec_id > 5")).count() == 0
    more = frame.unionByName(spark.createDataFrame([(2, [3.0, 2.5])], "vec_id long, embedding array<float>"))
    out = whitening.whiten(more).collect()  # one direction only
    assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9), r.deviation) for r in out) == [(i, 1, 1.0, 128**2 + 32**2) for i in ("1", "2", "None")]
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


# 12


def audit_by_hand(rows, min_docs, top):
    find = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    rows = [(lang or "", source or "", find(text)) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, w) for g, s, w in rows if g == lang]
        held = Counter(t for _, w in own for t in set(w))
        kept = [t for t in held if held[t] >= min_docs]
        count = {s: Counter(t for q, w in own if q == s for t in w if held[t] >= min_docs) for s, _ in own}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in p:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((q[t] - p[s][t], t) for t in kept if count[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(2)
    words = ["Ab", "ab", "aB", "é", "Éa", "中文字", "zz9zz", "x-y", "quite", "quitd", "quité", *[f"common{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)]]
    rows = []
    for i in range(400):
        source = rng.choice(["s1", "s2", "s3", "hot", "hot", "hot", None, "é"])
        some = words if source != "s3" else words[20:]
        rows.append((i, " ".join(rng.choices(some, k=rng.randrange(0, 25))), rng.choice(["en", "en", "de", None]), source))
    return rows + [(500, None, "en", "silent"), (501, "", "fr", "alone"), (502, "1 2 3", "xx", "u"), (503, None, "xx", "v"), (None, rows[0][1], "en", "s1"), (0, rows[0][1], "en", "s1")]


@pytest.mark.parametrize("min_docs,top,block", [(5, 50, 512), (3, 7, 2), (30, 1, 3)])
def test_divergence_equals_plain_counting(spark, monkeypatch, min_docs, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = divergence_rows()
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).repartition(5)
    out = divergence.audit(frame, min_docs, top)
    assert sorted(map(tuple, out.select("lang", "source", "part", "item", "value", "rank").collect())) == audit_by_hand(rows, min_docs, top)
    assert divergence.audit(frame.where("doc_id > 1000")).count() == 0


def test_radix_selection_among_ties(spark):
    """Values that tie in their hundreds, and terms that share long beginnings, one of which begins the next."""
    rng = random.Random(4)
    items = [("prefix" * 3) + "".join(rng.choices("abé", k=rng.randrange(0, 9))) for _ in range(3000)]
    rows = [(g, "s", t, rng.choice([7, 7, 7, 1 << 29, (1 << 29) + 1, 9])) for g in ("a", "b") for t in sorted(set(items))] + [("small", "s", "t", 3), ("exact", "s", "u", 5), ("exact", "s", "v", 5)]
    frame = spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(6)
    for top in (2, 150):
        out = divergence.top_by_radix(frame, top, Scratch(spark, "r")).collect()
        for g in ("a", "b", "small", "exact"):
            best = sorted(((-v, t.encode()) for lang, _, t, v in rows if lang == g))[:top]
            assert sorted((-r.value, r.item.encode()) for r in out if r.lang == g) == best


def test_pieces_of_a_long_text(monkeypatch):
    text = ("Some words, éà and 中文; " * 50 + "x" * 300 + " end").encode()
    whole = text.translate(divergence.LETTERS).split()
    for size in (1, 7, 64, 10_000):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [w for part in divergence.pieces(text) for w in part] == whole


# 13


def fingerprint_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgé中", k=rng.randrange(2, 8)))
    rows = [(i * 3, " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 400])))) for i in range(120)]
    return rows + [(5000, rows[1][1]), (-4, "é" * 5000), (None, "no id"), (None, "no id either"), (None, None), (33, None), (33, "twice"), (33, "twice")]


@pytest.mark.parametrize("ranges", [1, 4, 50, 400])
def test_fingerprints_of_neighbours(spark, ranges):
    rows = fingerprint_rows()
    hashes = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    out = fingerprint.compare_neighbours(frame, n_ranges=ranges).collect()
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    chunker, expected = fingerprint.DEFAULT, []
    for (i, text), (_, other) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, changed, following = (chunker.weights(t.encode()) for t in (text, edited, other))
        expected.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.pack(own), fingerprint.pack(changed), fingerprint.likeness(own, changed), fingerprint.likeness(own, following)))
    assert sorted((str(r.doc_id), *r[1:]) for r in out) == sorted(expected)
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame).collect()}[5000] == next(r.fingerprint for r in out if r.doc_id == 5000)


def test_one_document_and_none(spark):
    frame = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    r = fingerprint.compare_neighbours(frame).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.compare_neighbours(frame.where("doc_id > 1")).count() == 0


def test_half_of_the_rows_under_one_id(spark):
    frame = spark.range(600).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    out = fingerprint.compare_neighbours(frame, n_ranges=16)
    assert out.count() == 600 and out.where("doc_id = 7").count() == 300
    slim = frame.withColumn("hash", F.xxhash64("text"))
    assert fingerprint.neighbour_ranges(slim, 16).where("doc_id = 7 and not tail").groupBy("range").count().agg(F.max("count")).first()[0] < 60


def test_chunks(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)).encode()
    c = fingerprint.DEFAULT
    cuts = c.cuts(text)
    lengths = [b - a for a, b in zip([0, *cuts], cuts)]
    assert cuts[-1] == len(text) and max(lengths) <= c.most and min(lengths[:-1]) >= c.least
    # plain gear hash, byte by byte
    h, start, plain = 0, 0, []
    for i, b in enumerate(text):
        h = ((h << 1) + int(fingerprint.GEAR[b])) & 0xFFFF
        n = i + 1 - start
        if n == c.most or (n >= c.normal and h & c.loose == 0) or (n >= c.least and h & c.strict == 0):
            start = i + 1
            plain.append(start)
    assert cuts == (plain if plain and plain[-1] == len(text) else [*plain, len(text)])
    moved = c.weights(b"Something is put in front. " + text)
    assert fingerprint.likeness(c.weights(text), moved) > 0.99
    assert c.cuts(b"") == [] and fingerprint.pack({}) == "" and fingerprint.likeness({}, {}) == 1.0 and fingerprint.likeness({}, moved) == 0.0
    assert fingerprint.unpack(fingerprint.pack(moved)) == moved
