"""How far the sources of a language differ: a distance for every pair of sources, and the terms that mark a source.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that at least
`min_docs` of its documents hold. Every (language, source) group, and the language itself, gives each kept term the
smoothed share p = 1 + floor(UNIT * (count + ADD) / (N + ADD * V)); all arithmetic is on whole numbers.

Counting: tasks count a bounded number of terms and pass the sums on, so a frequent term meets its reducer as one row for
each task and source. Pairs: a term that both sources lack adds |p0 - p0'|, the difference of their shares of count 0, so
V times that is the baseline, and only terms with a count correct it: those of one source by running sums over its few
distinct shares, looked up at the other's p0 (a group's shares and the other groups' p0 in one order), those of both by
small matrices over blocks of sources, summed in the tasks. No pair of sources is made for a term. Ranking: the `top`-th
value of each group is found by radix selection. Histograms of the values' bits, highest first, narrow down the bucket
that holds it, and where values tie the terms' UTF-8 bytes go on in the same way; only rows that are chosen are sorted.

Defined results for odd input: null text, lang and source are ''; a group without kept terms has distances too (0 if its
language keeps no term) and no terms; a language of one source has no pairs; repeated rows are documents of their own;
very long texts are counted piece by piece; an empty table gives no rows; other columns are not read. A share needs
N + ADD * V and every sum of differences to fit into 64-bit integers; beyond that Spark raises an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import Scratch

UNIT, ADD = 1_000_000_000, 5
#: What is left of a byte in a term: letters in lower case, bytes of characters beyond ASCII, else a separator.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A task passes its counts on beyond so many (term, group) entries, or so many bytes of documents' distinct terms.
ENTRIES, TERM_BYTES = 400_000, 1 << 28
PIECE = 1 << 20
#: Sources whose shared terms are summed in one matrix, and matrices that a task keeps.
BLOCK, MATRICES = 512, 16
#: Values have at most VALUE_BITS bits, DIGIT_BITS of them a round; terms DIGIT_BYTES a round.
VALUE_BITS, DIGIT_BITS, DIGIT_BYTES = 30, 10, 2
GROUP = ["lang", "source"]


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, about PIECE bytes at a time. Only a term itself can make a piece longer."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + PIECE, n)
        part = text[at:end].translate(LETTERS)
        if end < n and (cut := part.rfind(b" ")) >= 0:
            part = part[: cut + 1]
            end = at + cut + 1
        else:
            while end < n and not part.endswith(b" "):
                further = text[end : end + PIECE].translate(LETTERS)
                cut = further.find(b" ")
                part += further if cut < 0 else further[: cut + 1]
                end += len(further) if cut < 0 else cut + 1
        yield part.split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as tasks have counted them: several rows for a term are to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        entries = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array([t.decode("utf-8", "replace") for t in some], pa.string())]
                        + [pa.array([c[t] for t in some], pa.int64()) for c in (n, d)],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            counts.clear()

        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in pieces(text):
                    n.update(terms)
                    seen.update(terms)
                was = len(d)
                d.update(seen)
                if len(d) > was:
                    entries += len(d) - was
                    size += sum(map(len, seen))
                if entries > ENTRIES or size > TERM_BYTES:
                    yield from flush()
                    entries = size = 0
        yield from flush()

    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, n_terms: str) -> Column:
    return F.expr(f"1 + cast({UNIT} as decimal(10, 0)) * cast({count} + {ADD} as decimal(20, 0)) div cast({total} + {ADD} * {n_terms} as decimal(20, 0))")


def kept_terms(counted: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n_lang, postings): a row for each kept term, with an array (source, n) of as many elements as sources hold it."""
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return by_term.where(F.col("docs") >= min_docs).drop("docs")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, sid, total, n_terms, total_lang, p0) of every group that occurs; sid counts a language's sources from 0."""
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    totals = kept.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("total_lang"))
    out = occurring.join(totals, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "n_terms", "total_lang"])
    sid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return out.withColumn("sid", sid).withColumn("p0", F.when(F.col("n_terms") > 0, share("0", "total", "n_terms")).otherwise(0))


def scored_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, sid, term, p, p0, q) of every count above 0: the group's share, its share of count 0, the language's share."""
    postings = kept.select("lang", "term", "n_lang", F.explode("postings").alias("x")).select("lang", "term", "n_lang", "x.source", "x.n")
    joined = postings.join(groups, GROUP)
    return joined.select("lang", "source", "sid", "term", share("n", "total", "n_terms").alias("p"), "p0", share("n_lang", "total_lang", "n_terms").alias("q"))


def own_corrections(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, v): the sum over a's terms of |p - p0 of b| - |p0 of a - p0 of b|, by running sums over a's distinct shares."""
    a, b = (groups.select("lang", F.col("sid").alias(x), F.col("p0").alias(f"p0_{x}")) for x in "ab")
    asked = a.join(b, "lang").where("a <> b").select("lang", "a", F.col("p0_b").alias("x"), F.lit(0).cast("long").alias("k"), "b", F.abs(F.col("p0_a") - F.col("p0_b")).alias("base"))
    shares = scored.groupBy("lang", F.col("sid").alias("a"), F.col("p").alias("x")).agg(F.count("*").alias("k"))
    events = asked.unionByName(shares, allowMissingColumns=True)
    below = Window.partitionBy("lang", "a").orderBy("x", F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("lang", "a")
    kx = F.col("k") * F.col("x")
    summed = events.select("*", F.sum("k").over(below).alias("k_below"), F.sum(kx).over(below).alias("s_below"), F.sum("k").over(every).alias("k_all"), F.sum(kx).over(every).alias("s_all"))
    return summed.where("b is not null").selectExpr("lang", "a", "b", "x * (2 * k_below - k_all) + s_all - 2 * s_below - k_all * base AS v")


def shared_corrections(scored: DataFrame) -> DataFrame:
    """(lang, a, b, v), a < b: the sum over the terms of both of |p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|.

    A term's sources come in blocks of BLOCK, and pairs of blocks, not of sources, are joined."""
    blocks = scored.groupBy("lang", "term", F.expr(f"sid div {BLOCK}").cast("int").alias("block")).agg(F.collect_list(F.struct("sid", "p", "p0")).alias("rows"))
    right = blocks.select("lang", "term", F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    pairs = blocks.join(right, ["lang", "term"]).where("block <= block_b").select("lang", "block", "block_b", "rows", "rows_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def emit(key: tuple) -> pa.RecordBatch:
            lang, left, right = key
            found = np.triu(sums[key], 1) if left == right else sums[key]
            i, j = np.nonzero(found)
            del sums[key]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + left * BLOCK, pa.int32()), pa.array(j + right * BLOCK, pa.int32()), pa.array(found[i, j], pa.int64())], names=["lang", "a", "b", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            sides = []
            for column in (batch.column(3), batch.column(4)):
                values = column.values
                sides.append((column.offsets.to_pylist(), *(values.field(i).to_numpy() for i in range(3))))
            for row, key in enumerate(keys):
                (i, p, p0), (j, r, r0) = [[x[at[row] : at[row + 1]] for x in columns] for at, *columns in sides]
                p, p0 = p[:, None], p0[:, None]
                more = np.abs(p - r) - np.abs(p - r0) - np.abs(p0 - r) + np.abs(p0 - r0)
                total = sums.pop(key, None)
                if total is None:
                    if len(sums) >= MATRICES:
                        yield emit(next(iter(sums)))
                    total = np.zeros((BLOCK, BLOCK), np.int64)
                total[np.ix_(i - key[1] * BLOCK, j - key[2] * BLOCK)] += more
                sums[key] = total
        for key in list(sums):
            yield emit(key)

    return pairs.mapInArrow(run, "lang string, a int, b int, v long").groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))


def source_pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) for every two sources of a language."""
    a, b = (groups.select("lang", "n_terms", F.col("source").alias(name), F.col("sid").alias(x), F.col("p0").alias(f"p0_{x}")) for x, name in (("a", "source"), ("b", "item")))
    base = a.join(b, ["lang", "n_terms"]).where("a <> b").selectExpr("lang", "a", "b", "source", "item", "n_terms * abs(p0_a - p0_b) AS v")
    own, shared = own_corrections(scored, groups), shared_corrections(scored)
    for part in (own, shared):
        for turned in (part, part.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")):
            base = base.unionByName(turned, allowMissingColumns=True)
    out = base.groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("v").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return out.select("lang", "source", "item", "value", rank.alias("rank"))


def top_by_radix(rows: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """The `top` rows (lang, source, item, value) of every group by value, descending, then by item's UTF-8 bytes.

    A round takes the next digit: of the values' bits, highest first, then of the items' bytes. Its histogram over the rows
    of each group's bucket says which digit holds the last row wanted, and how many of it. Rounds end when all of every
    such bucket is wanted."""
    code = F.hex(F.col("item").cast("binary"))
    state = scratch.save(rows.select(*GROUP).distinct().select(*GROUP, F.lit(0).cast("long").alias("value_from"), F.lit("").alias("code_to"), F.lit(0).alias("depth"), F.lit(top).cast("long").alias("need"), F.lit(False).alias("done")), "radix")
    shift, depth = VALUE_BITS, 0
    while True:
        named = state.select(F.col("lang").alias("g"), F.col("source").alias("h"), "value_from", "code_to", "need").where("not done")
        of_values = shift > 0
        joined = rows.join(named, (F.col("lang") == F.col("g")) & (F.col("source") == F.col("h")))
        if of_values:
            joined = joined.where(F.shiftright("value", shift) == F.shiftright("value_from", shift))
            shift -= DIGIT_BITS
            digit = F.bitwise_not(F.shiftright("value", shift))  # largest first
        else:
            chars, depth = 2 * DIGIT_BYTES * depth, depth + 1
            joined = joined.where((F.col("value") == F.col("value_from")) & (F.substring(code, 1, chars) == F.col("code_to")))
            digit = F.substring(code, 1, chars + 2 * DIGIT_BYTES)
        found = joined.groupBy(*GROUP, "need", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*GROUP).orderBy("digit"))
        last = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("digit"))) == 1
        found = found.select("*", upto.alias("upto"), last.alias("last"))
        # The bucket of the last row wanted; of a group with fewer rows, its last bucket.
        found = found.where("upto - n < need and (need <= upto or last)").withColumn("left", F.col("need") - F.col("upto") + F.col("n"))
        found = found.select(F.col("lang").alias("g"), F.col("source").alias("h"), "digit", "left", (F.col("left") >= F.col("n")).alias("all"))
        step = state.join(found, (F.col("lang") == F.col("g")) & (F.col("source") == F.col("h")), "left")
        hit = F.col("digit").isNotNull()
        if of_values:
            moved = {"value_from": F.when(hit, F.shiftleft(F.bitwise_not("digit"), shift)).otherwise(F.col("value_from"))}
        else:
            moved = {"code_to": F.when(hit, F.col("digit")).otherwise(F.col("code_to")), "depth": F.when(hit, depth).otherwise(F.col("depth"))}
        moved |= {"need": F.when(hit, F.col("left")).otherwise(F.col("need")), "done": F.col("done") | F.coalesce("all", F.lit(False))}
        new = scratch.save(step.withColumns(moved).select(*state.columns), "radix")
        scratch.drop(state)
        state = new
        if state.where("not done").isEmpty():
            break
    s = state.select(F.col("lang").alias("g"), F.col("source").alias("h"), "value_from", "code_to", "depth")
    chosen = rows.join(s, (F.col("lang") == F.col("g")) & (F.col("source") == F.col("h")))
    in_bucket = (F.col("depth") == 0) | (F.expr(f"substring(hex(cast(item as binary)), 1, {2 * DIGIT_BYTES} * depth)") <= F.col("code_to"))
    return chosen.where((F.col("value") > F.col("value_from")) | ((F.col("value") >= F.col("value_from")) & in_bucket)).select(*rows.columns)


def marking_terms(scored: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more often than its language, by how much more."""
    rows = scored.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    chosen = top_by_radix(scratch.save(rows, "marking"), top, scratch)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return chosen.select(*GROUP, "item", "value", rank.alias("rank"))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = scratch.save(kept_terms(count_terms(docs), min_docs), "kept")
    groups = scratch.save(group_table(docs, kept), "groups")
    scored = scratch.save(scored_terms(kept, groups), "scored")
    parts = {"pair": source_pairs(scored, groups), "term": marking_terms(scored, top, scratch)}
    pair, term = (df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, df in parts.items())
    return pair.unionByName(term)
