"""Level by level merging against a plain loop."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marlpit.operators.reduction import reduce_notes
from marlpit.plans import transcripts

SF = "/root/testdata/sf0.001"


def tokens(n):
    return max(1, n // 3)


def by_hand(notes, merge, budget):
    levels = 0
    while tokens(sum(map(len, notes)) + 2 + 2 * (len(notes) - 1)) > budget:
        groups, used = [[]], 0
        for n in notes:
            if groups[-1] and used + tokens(len(n)) > budget:
                groups.append([])
                used = 0
            groups[-1].append(n)
            used += tokens(len(n))
        if len(groups) == len(notes):
            return notes, levels, False
        notes = [merge(g) if len(g) > 1 else g[0] for g in groups]
        levels += 1
    return notes, levels, True


def halves(groups):
    """Half of each note."""
    return groups.select("lecture_id", "group_no", F.concat(F.lit("["), F.array_join(F.transform("notes", lambda n: F.substring(n, F.lit(1), F.floor(F.length(n) / 2).cast("int"))), ""), F.lit("]")).alias("note"))


def test_reduction(spark):
    rng = random.Random(1)
    notes = {i: ["x" * rng.randrange(1, 200) + chr(97 + k % 26) for k in range(rng.choice([1, 2, 9, 60]))] for i in range(12)}
    notes |= {100: ["y" * 900, "z" * 900], 101: ["y" * 900], 102: ["a" * 5] * 500}
    frame = spark.createDataFrame([(i, k, n) for i, ns in notes.items() for k, n in enumerate(ns)], "lecture_id long, part int, note string").repartition(5)
    out = {}
    for r in reduce_notes(frame, halves, 100).orderBy("lecture_id", "part").collect():
        out.setdefault(r.lecture_id, ([], r.levels, r.complete))[0].append(r.note)
    assert out == {i: by_hand(ns, lambda g: "[" + "".join(n[: len(n) // 2] for n in g) + "]", 100) for i, ns in notes.items()}
    assert {x[1] for x in out.values()} >= {0, 1, 2} and out[100][1:] == (0, False) == out[101][1:]
    assert reduce_notes(frame.where("lecture_id < 0"), halves, 100).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query(spark):
    import hashlib

    notes = {}
    for r in transcripts.t.segments(spark, SF).orderBy("lecture_id", "sequence").collect():
        notes.setdefault(r.lecture_id, []).append(json.dumps({"t": r.raw_text or ""}, ensure_ascii=False, separators=(",", ":")))
    merge = lambda g: json.dumps({"t": " ".join(json.loads(n)["t"][:40] for n in g), "n": len(g)}, ensure_ascii=False, separators=(",", ":"))
    expected = {(i, k, levels, fits, hashlib.sha256(n.encode()).hexdigest()) for i, ns in notes.items() for left, levels, fits in [by_hand(ns, merge, 120)] for k, n in enumerate(left)}
    got = [tuple(r) for r in transcripts.note_reduction(spark, SF).select("lecture_id", "part", "levels", "complete", "note_sha256").collect()]
    assert {(i, l, f) for i, _, l, f, _ in got} == {(i, l, f) for i, _, l, f, _ in expected} and len(got) == len(expected)
    assert {(i, h) for i, _, _, _, h in got} == {(i, h) for i, _, _, _, h in expected}
