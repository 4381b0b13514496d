"""Banded alignment against the full table."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions.text import spoken
from marlpit.operators import wer
from marlpit.plans import evaluation

SF = "/root/testdata/sf0.001"


def whole_table(r, h):
    """Every cell with its least cost and edits; of equal ways the replacement, then the deletion, then the insertion."""
    above = [(j, 0, 0, j) for j in range(len(h) + 1)]
    for i, x in enumerate(r, 1):
        row = [(i, 0, i, 0)]
        for j, y in enumerate(h, 1):
            c, s, d, n = above[j - 1]
            ways = [(c + (x != y), s + (x != y), d, n)]
            c, s, d, n = above[j]
            ways.append((c + 1, s, d + 1, n))
            c, s, d, n = row[-1]
            ways.append((c + 1, s, d, n + 1))
            row.append(min(ways, key=lambda w: w[0]))
        above = row
    return above[-1][1:]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30)), max_size=12))
def test_pairs_with_many_ties(pairs):
    left, right = ([np.array(p[i], np.int32) for p in pairs] for i in (0, 1))
    assert [tuple(x) for x in wer.edit_counts(left, right).tolist()] == [whole_table(*p) for p in pairs]


def test_bands_that_grow():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        a = [rng.randrange(4) for _ in range(rng.randrange(150))]
        b = [x for x in a if rng.random() > rng.choice([0.02, 0.5])] + [rng.randrange(4) for _ in range(rng.randrange(60))]
        pairs.append((a, rng.choice([b, b[::-1], a + b, a[len(a) // 2 :]])))
    left, right = ([np.array(p[i], np.int32) for p in pairs] for i in (0, 1))
    assert [tuple(x) for x in wer.edit_counts(left, right).tolist()] == [whole_table(*p) for p in pairs]


def test_long_text_with_few_errors_takes_a_narrow_band(monkeypatch):
    widths = []
    inner = wer._in_band
    monkeypatch.setattr(wer, "_in_band", lambda left, right, reach: widths.append(reach) or inner(left, right, reach))
    a = np.arange(20_000, dtype=np.int32) % 977
    assert wer.edit_counts([a], [np.delete(a, [5, 10_000])]).tolist() == [[0, 2, 0]] and widths == [8]


def test_character_limit(spark):
    rows = [(1, "a b c", "a x c"), (2, "w" * 5001, "w" * 5001), (3, "w", "w" * 5001), (4, "w" * 5000, "w" * 4999), (5, None, "one two"), (6, None, None)]
    frame = spark.createDataFrame(rows, "id long, reference string, hypothesis string")
    counts = wer.error_counts(frame)
    out = {r.id: (r.errors, r.wer, r.char_errors, r.n_chars, r.cer) for r in counts.collect()}
    assert out == {1: (1, 0.333333, 1, 3, 0.333333), 2: (0, 0.0, None, None, None), 3: (1, 1.0, None, None, None), 4: (1, 1.0, 1, 5000, 0.0002), 5: (2, None, 6, 0, None), 6: (0, None, 0, 0, None)}
    t = wer.corpus_rates(counts).first()
    assert (t.n_items, t.n_char_items, t.n_char_skipped, t.errors, t.char_errors, t.n_chars) == (6, 4, 2, 5, 8, 5003)
    assert (t.word_substitutions, t.word_insertions, t.char_deletions) == (3, 2, 1)
    assert {r.id: r.n_chars for r in wer.error_counts(frame, None).collect()}[2] == 5001
    none = wer.corpus_rates(wer.error_counts(frame.where("id > 9"))).first()
    assert (none.n_items, none.errors, none.wer, none.cer) == (0, None, None, None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_equal_the_whole_table(spark):
    pairs = evaluation._pairs(spark, SF).select("id", spoken(F.col("reference")).alias("r"), spoken(F.col("hypothesis")).alias("h")).collect()
    by_word = {p.id: whole_table(p.r.split(), p.h.split()) for p in pairs}
    assert {r.id: (r.substitutions, r.deletions, r.insertions) for r in evaluation.edit_breakdown(spark, SF).collect()} == by_word
    out = evaluation.wer_total(spark, SF).collect()
    short = [p for p in pairs if len(p.r) < 120][:20]
    by_char = {p.id: whole_table(p.r.replace(" ", ""), p.h.replace(" ", "")) for p in short}
    assert short and {r.id: (r.char_substitutions, r.char_deletions, r.char_insertions) for r in out if r.id in by_char} == by_char
    total = evaluation.corpus_wer(spark, SF).first()
    assert total.errors == sum(map(sum, by_word.values())) == sum(r.errors for r in out) and total.n_items == len(pairs)
    assert total.n_words == sum(len(p.r.split()) for p in pairs) and total.char_errors == sum(r.char_errors for r in out)
