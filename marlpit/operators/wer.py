"""Word and character error rates by banded alignment.

An alignment of cost d never leaves the diagonal by more than d, so a band of that half width holds every least one, and
what a tie would choose. The band starts near the difference of the lengths and doubles until the cost fits into it: work
is in proportion to length times errors, not to the square of the length. Pairs of a batch with like lengths and bands go
through the rows together, as one array operation a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.text import spoken

#: Texts with more characters than this have no character errors, as the contract of the reports says. None: no limit.
CHARACTER_LIMIT = 5000
#: Half width of the first band, array cells of pairs that go together, and rows of a batch taken at once.
FIRST_BAND, CELLS, SLICE = 8, 1 << 17, 2048
KINDS = ("substitutions", "deletions", "insertions")
_FAR = 1 << 29


def _in_band(left: list[np.ndarray], right: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Cost and insertions of each pair's least alignment that stays within `reach` of the diagonal; the cost is exact if
    it is at most reach. Column b of row i is the cell (i, i + b - reach)."""
    n, m = (np.array([len(x) for x in side]) for side in (left, right))
    pairs, width, rows = len(left), 2 * reach + 1, int(n.max())
    a, b = np.full((pairs, rows), -1, np.int32), np.full((pairs, rows + width), -2, np.int32)
    for k, (x, y) in enumerate(zip(left, right)):
        a[k, : len(x)] = x
        b[k, reach : reach + min(len(y), rows + reach)] = y[: rows + reach]
    at = np.arange(width, dtype=np.int32)
    cost = np.where(at >= reach, at - reach, _FAR).astype(np.int32) * np.ones((pairs, 1), np.int32)
    inserted = np.where(at >= reach, at - reach, 0).astype(np.int32) * np.ones((pairs, 1), np.int32)
    base = (np.arange(pairs, dtype=np.int64) * width)[:, None]
    end, out = m - n + reach, np.zeros((2, pairs), np.int64)
    every = np.arange(pairs)

    def keep(row: int) -> None:
        here = every[n == row]
        out[0, here], out[1, here] = cost[here, end[here]], inserted[here, end[here]]

    keep(0)
    last = np.full((pairs, 1), _FAR, np.int32)
    stops = set(n.tolist())
    for i in range(rows):
        replaced = cost + (b[:, i : i + width] != a[:, i : i + 1])
        deleted = np.concatenate([cost[:, 1:], last], axis=1) + 1
        least = np.minimum(replaced, deleted)
        # Among equals a replacement goes before a deletion, and both before an insertion.
        ways = np.where(replaced <= deleted, inserted, np.concatenate([inserted[:, 1:], inserted[:, -1:]], axis=1))
        cost = np.minimum.accumulate(least - at, axis=1) + at
        source = np.maximum.accumulate(np.where(cost == least, at, 0), axis=1)
        inserted = ways.ravel()[source + base] + (at - source)
        if i + 1 in stops:
            keep(i + 1)
    return out[0], out[1]


def edit_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """A row of substitutions, deletions and insertions for each pair of integer sequences: those of a least alignment, which
    prefers a replacement to a deletion and a deletion to an insertion."""
    out = np.zeros((len(left), 3), np.int64)
    reach = {}
    for k, (x, y) in enumerate(zip(left, right)):
        if len(x) == 0 or len(y) == 0:
            out[k] = 0, len(x), len(y)
        elif not (len(x) == len(y) and (x == y).all()):
            reach[k] = FIRST_BAND
            while reach[k] < abs(len(x) - len(y)):
                reach[k] *= 2
    while reach:
        order = sorted(reach, key=lambda k: (reach[k], len(left[k])))
        at = 0
        while at < len(order):
            band, least = reach[order[at]], len(left[order[at]])
            most, upto = max(1, CELLS // (2 * band + 1)), at + 1
            while upto < len(order) and upto - at < most and reach[order[upto]] == band and len(left[order[upto]]) <= 1.5 * least + 16:
                upto += 1
            group, at = order[at:upto], upto
            cost, inserted = _in_band([left[k] for k in group], [right[k] for k in group], band)
            for k, c, i in zip(group, cost.tolist(), inserted.tolist()):
                if c <= band:
                    deleted = i + len(left[k]) - len(right[k])
                    out[k] = c - i - deleted, deleted, i
                    del reach[k]
                else:
                    reach[k] *= 2
    return out


def alignment(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of one pair of word lists."""
    numbers: dict[str, int] = {}
    sides = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32) for words in (reference, hypothesis)]
    return tuple(edit_counts(sides[:1], sides[1:])[0].tolist())


def aligned(pairs: DataFrame, character_limit: int | None = CHARACTER_LIMIT) -> DataFrame:
    """pairs (id, r, h) of normalised texts -> (id, n_words, word_*, n_chars, char_*): edits of words, and of characters
    without spaces. char_* are NULL where a side has more than character_limit characters; NULL texts are empty."""
    names = ["id", "n_words", *[f"word_{k}" for k in KINDS], "n_chars", *[f"char_{k}" for k in KINDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = [[t or "" for t in part.column(i).to_pylist()] for i in (1, 2)]
            numbers: dict[str, int] = {}
            words = [[np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.int32) for t in side] for side in texts]
            chars = [[np.frombuffer(t.replace(" ", "").encode("utf-32-le", "surrogatepass"), np.int32) for t in side] for side in texts]
            scored = [k for k, (x, y) in enumerate(zip(*chars)) if character_limit is None or max(len(x), len(y)) <= character_limit]
            by_word, some = edit_counts(*words), edit_counts(*([side[k] for k in scored] for side in chars))
            by_char = np.zeros((part.num_rows, 3), np.int64)
            by_char[scored] = some
            skipped = np.ones(part.num_rows, bool)
            skipped[scored] = False
            columns = [part.column(0), pa.array([len(x) for x in words[0]], pa.int64()), *[pa.array(by_word[:, i]) for i in range(3)]]
            columns += [pa.array([len(x) for x in chars[0]], pa.int64()), *[pa.array(by_char[:, i], mask=skipped) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    slim = pairs.select(F.col("id").cast("long").alias("id"), "r", "h")
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def error_counts(pairs: DataFrame, character_limit: int | None = CHARACTER_LIMIT) -> DataFrame:
    """pairs (id, reference, hypothesis) with errors, n_words, wer, char_errors, n_chars, cer and the kinds of edits, on normalised
    texts; rates of an empty reference are NULL, and so are the character columns of texts beyond the limit."""
    p = aligned(pairs.select("id", spoken(F.col("reference")).alias("r"), spoken(F.col("hypothesis")).alias("h")), character_limit)
    rate = lambda e, n: F.round(F.try_divide(e.cast("double"), n), 6)
    errors, char_errors = (sum((F.col(f"{side}_{k}") for k in KINDS[1:]), F.col(f"{side}_{KINDS[0]}")) for side in ("word", "char"))
    n_chars = F.when(char_errors.isNotNull(), F.col("n_chars"))
    rates = [errors.alias("errors"), "n_words", rate(errors, F.col("n_words")).alias("wer"), char_errors.alias("char_errors"), n_chars.alias("n_chars"), rate(char_errors, n_chars).alias("cer")]
    return p.select("id", *rates, *[f"{side}_{k}" for side in ("word", "char") for k in KINDS])


def corpus_rates(counts: DataFrame) -> DataFrame:
    """Sums of errors over sums of lengths, for words and characters; NULL where there is nothing to err on. n_items and
    n_char_items are the pairs counted, n_char_skipped those whose characters are too many."""
    rate = lambda e, n: F.round(F.try_divide(F.sum(e).cast("double"), F.sum(n)), 6)
    sums = [F.sum(c).alias(c) for c in ("errors", "n_words", "char_errors", "n_chars", *[f"{side}_{k}" for side in ("word", "char") for k in KINDS])]
    items = [F.count("*").alias("n_items"), F.count("char_errors").alias("n_char_items"), F.count_if(F.col("char_errors").isNull()).alias("n_char_skipped")]
    return counts.agg(*items, *sums, rate("errors", "n_words").alias("wer"), rate("char_errors", "n_chars").alias("cer"))


def edit_breakdown(pairs: DataFrame) -> DataFrame:
    """pairs (id, r, h) of normalised texts -> (id, substitutions, deletions, insertions) of words."""
    return aligned(pairs, character_limit=0).select("id", *[F.col(f"word_{k}").alias(k) for k in KINDS])


def run_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs (id, status, hypothesis): ids missing on a side, or with another status or hypothesis."""
    a = first.select(F.col("id"), F.col("status").alias("status_a"), F.col("hypothesis").alias("hyp_a"), F.lit(True).alias("in_a"))
    b = second.select(F.col("id"), F.col("status").alias("status_b"), F.col("hypothesis").alias("hyp_b"), F.lit(True).alias("in_b"))
    kind = (
        F.when(F.col("in_a").isNull(), "only_second").when(F.col("in_b").isNull(), "only_first").when(~F.col("status_a").eqNullSafe(F.col("status_b")), "status").when(~F.col("hyp_a").eqNullSafe(F.col("hyp_b")), "hypothesis")
    )
    return a.join(b, "id", "full").select("id", kind.alias("difference")).where("difference is not null")
