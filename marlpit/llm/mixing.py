"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and max_rate. Among all rates that meet the sources' word targets, those with the
largest entropy relative to base_rate (one copy of each document) are taken; they are exponentially tilted:
log(w / (max_rate - w)) is the base rate's, plus a multiplier of the source times the document's size, so a source that is
to give more words than it has takes its long documents more often, and one that is to give fewer its short ones. The
multipliers solve a convex dual by Newton steps (kept inside a bracket), each step one aggregation of (source, size) counts. Rates become whole copies:
sizes of a source are visited from large to small, each taking the number of copies that brings the running sum of words
nearest to what the rates ask for, and the copies are dealt among the documents of that size in order of a hash.

Only sizes and hashes are shuffled. Of every (source, size) a row says how many copies each document takes and up to which
hash they take one more; every document looks that up where it is read, and its text stays there. These rows are broadcast
where they are at most BROADCAST_BINS, and joined as Spark chooses beyond that.

Defined results for odd input: a null text has size 0 and such documents take nothing; a null source is a source, the last;
repeated rows count each on its own: of rows with one doc_id, which have one hash, as many as are wanted on average take
another copy, by their place in the table; very long texts are counted like others, as a size of their own; an empty table
gives no rows; other columns pass through, except those named like the results.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import ASCII_SPACE, Scratch

RESULTS = ["size", "source_size", "target", "copies", "taken"]
#: Rows (source, size) of some hundred bytes that may be broadcast.
BROADCAST_BINS = 500_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), total_rate: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size) -> with weight and target. One row for each source, so one task orders them.

    Targets share total_rate of all sizes by weight; a target above max_rate times its source's size stops there and the
    excess goes to the others by weight. With sources in order of max_rate * size / weight the first of them stop: the
    water level after stopping k of them is what is left over the weights left, and the first k whose level the next
    source can hold is the answer."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_rate))).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(total_rate)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    return ranked.withColumn("at", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", "weight", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def solve_multipliers(bins: DataFrame, targets: DataFrame, scratch: Scratch, max_rate: float = 2.0, base_rate: float = 1.0, tolerance: float = 1e-9, max_steps: int = 100) -> DataFrame:
    """(source, scale, target, share, mult): by Newton, each source's multiplier of size / scale, its mean size of words.

    bins: (source, size, n) with size > 0. share is the target's of max_rate times the source's size; a source at its cap,
    or without a target, needs no multiplier."""
    base = bins.groupBy("source").agg(F.try_divide(F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")), F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = base.join(targets, base["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size") * F.lit(max_rate)), F.lit(0.0))
    state = state.select("source", "scale", "target", share.alias("share"), F.lit(0.0).alias("mult"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    state = scratch.save(state.withColumn("done", (F.col("share") <= 0) | (F.col("share") >= 1 - 1e-12)), "newton")
    for _ in range(max_steps):
        joined = bins.join(state.where("not done"), bins["source"].eqNullSafe(state["source"])).drop(bins["source"])
        x = F.col("size") / F.col("scale")
        p = _tilted(max_rate, base_rate)
        words = F.col("size") * F.col("n")
        sums = joined.groupBy("source").agg(F.sum(words * F.lit(max_rate) * p).alias("got"), F.sum(words * F.lit(max_rate) * p * (1 - p) * x).alias("slope"))
        step = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("got") - F.col("target")
        step = step.withColumn("low", F.when(gap < 0, F.col("mult")).otherwise(F.col("low"))).withColumn("high", F.when(gap > 0, F.col("mult")).otherwise(F.col("high")))
        newton = F.col("mult") - F.try_divide(gap, F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(F.col("high") - F.col("low") > 1e5, F.col("mult") - 4 * F.signum(gap) * (1 + F.abs("mult"))).otherwise((F.col("low") + F.col("high")) / 2)
        # A bracket that rounding closes is the answer too.
        met = (F.abs(gap) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.col("target"))) | (F.col("high") - F.col("low") <= 1e-15 * F.abs("mult"))
        step = step.withColumn("mult", F.when(F.col("done") | met, F.col("mult")).when(inside, newton).otherwise(middle)).withColumn("done", F.col("done") | met)
        new = scratch.save(step.drop("got", "slope"), "newton")
        scratch.drop(state)
        state = new
        if state.where("not done").isEmpty():
            break
    return state.select("source", "scale", "target", "share", "mult")


def _tilted(max_rate: float, base_rate: float) -> Column:
    """Of columns mult, size and scale: the rate over max_rate."""
    z = F.lit(math.log(base_rate / (max_rate - base_rate))) + F.col("mult") * F.col("size") / F.col("scale")
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def tilted_rates(bins: DataFrame, targets: DataFrame, scratch: Scratch, max_rate: float = 2.0, base_rate: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """bins (source, size, n) with `rate` for every bin."""
    solved = solve_multipliers(bins, targets, scratch, max_rate, base_rate, tolerance)
    rate = F.when(F.col("share") >= 1 - 1e-12, F.lit(max_rate)).when(F.col("share") <= 0, F.lit(0.0)).otherwise(F.lit(max_rate) * _tilted(max_rate, base_rate))
    return bins.join(solved, bins["source"].eqNullSafe(solved["source"])).drop(solved["source"]).select("source", "size", "n", rate.alias("rate"))


def bin_copies(rated: DataFrame, max_rate: float = 2.0) -> DataFrame:
    """(source, size, n, copies) of bins with rates: from large sizes to small ones of each source.

    A source is one group, of a row for each size that its documents have, however many these are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        wanted = taken = 0.0
        copies = []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            wanted += size * n * rate
            c = int(min(int(max_rate) * n, max(0, round((wanted - taken) / size))))
            taken += c * size
            copies.append(c)
        return pdf.assign(copies=copies)[["source", "size", "n", "copies"]]

    return rated.groupBy("source").applyInPandas(run, "source string, size long, n long, copies long")


def cut_hashes(narrow: DataFrame, fine: DataFrame, copies: DataFrame) -> DataFrame:
    """(source, size, each, cut, tied, more): every document of a bin takes `each` copies, those of a hash below cut one more,
    and so do `more` of the `tied` documents whose hash it is. Documents are counted by slices of the hash, so only those of
    the slice that holds the cut are put in order."""
    wanted = copies.select(F.col("source").alias("s"), F.col("size").alias("z"), F.expr("copies div n").alias("each"), F.expr("copies % n").alias("rest"))
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = fine.withColumn("upto", F.sum("n").over(by_slice))
    here = slices.join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("upto") - F.col("n") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    here = here.select("s", "z", F.col("slice").alias("l"), (F.col("rest") - F.col("upto") + F.col("n")).alias("need"))
    rows = narrow.join(here, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("l")))
    hashes = rows.groupBy("source", "size", "need", "hash").agg(F.count("*").alias("tied"))
    in_bin = Window.partitionBy("source", "size").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = hashes.withColumn("upto", F.sum("tied").over(in_bin)).where("upto - tied < need and need <= upto")
    cuts = cuts.select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("hash").alias("cut"), "tied", (F.col("need") - F.col("upto") + F.col("tied")).alias("more"))
    out = wanted.join(cuts, F.col("s").eqNullSafe(F.col("cs")) & (F.col("z") == F.col("cz")), "left")
    return out.where("each > 0 or rest > 0").select(F.col("s").alias("source"), F.col("z").alias("size"), "each", "cut", "tied", "more")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), total_rate: float = 1.5, max_rate: float = 2.0, base_rate: float = 1.0, rows_per_task: int = 500_000) -> DataFrame:
    """docs with size, source_size, target (its source's), copies (at most max_rate, a whole number) and taken = copies * size.

    Slices of the hash are as many as keep one of a (source, size) below rows_per_task rows, 64 at least."""
    if max_rate != int(max_rate):
        raise ValueError("copies are whole: max_rate must be a whole number")
    if not 0 < base_rate < max_rate:
        raise ValueError("base_rate must lie between 0 and max_rate")
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.drop(*RESULTS).withColumn("size", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[^{ASCII_SPACE}]+"), F.lit(0))).cast("long"))
    narrow = scratch.save(rows.select(F.col("source").cast("string").alias("source"), "size", F.xxhash64("doc_id").alias("hash")), "sizes")
    slices = max(64, narrow.count() // rows_per_task)
    narrow = narrow.withColumn("slice", F.shiftright((F.shiftright("hash", 32) + F.lit(1 << 31)) * F.lit(slices), 32).cast("int"))
    fine = scratch.save(narrow.groupBy("source", "size", "slice").agg(F.count("*").alias("n")), "slices")
    bins = scratch.save(fine.groupBy("source", "size").agg(F.sum("n").alias("n")), "bins")
    targets = scratch.save(source_targets(bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total_rate, max_rate), "targets")
    rated = tilted_rates(bins.where("size > 0"), targets, scratch, max_rate, base_rate)
    cuts = scratch.save(cut_hashes(narrow, fine, bin_copies(rated, max_rate)), "cuts")
    found = cuts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("more") < F.col("tied")), F.lit(False)).alias("parted")).first()
    extra = F.when(F.col("__hash") < F.col("__cut"), 1).when(F.col("__hash") > F.col("__cut"), 0)
    # Rows of one hash that don't all take another copy: no column tells them apart.
    extra = extra.otherwise(F.when(F.pmod(F.xxhash64("__place"), F.col("__tied")) < F.col("__more"), 1).otherwise(0) if found.parted else F.lit(1))
    c = cuts.select(F.col("source").alias("__s"), F.col("size").alias("__z"), *[F.col(x).alias(f"__{x}") for x in ("each", "cut", "tied", "more")])
    t = targets.select(F.col("source").alias("__t"), "source_size", "target")
    t = F.broadcast(t) if t.count() <= BROADCAST_BINS else t
    placed = rows.withColumn("__hash", F.xxhash64("doc_id"))
    if found.parted:
        placed = placed.withColumn("__place", F.monotonically_increasing_id())
    placed = placed.join(F.broadcast(c) if found.n <= BROADCAST_BINS else c, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")), "left")
    copies = F.coalesce(F.col("__each") + F.when(F.col("__cut").isNull(), 0).otherwise(extra), F.lit(0)).cast("long")
    placed = placed.withColumn("copies", copies).join(t, F.col("source").eqNullSafe(F.col("__t")), "left")
    placed = placed.withColumn("taken", F.col("copies") * F.col("size"))
    return placed.drop(*[x for x in placed.columns if x.startswith("__") and x not in docs.columns])
