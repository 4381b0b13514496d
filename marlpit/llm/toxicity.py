"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning (fit) uses a bounded sample: at most SAMPLE_PER_CLASS labelled documents of each class, of lowest hash.
Words get log-odds of being in toxic rather than clean documents under a Dirichlet prior that is the pooled word
distribution with PRIOR_SHARE of its weight (Monroe et al., 2008); words whose log-odds are Z standard errors from 0
count, at most MAX_WORDS of them; beginnings of words count as words do, and a word that isn't known has the weight of
its longest known beginning. A token scores its log-odds less DRIFT, so that clean text drifts down. In a clean
document of n words the best segment exceeds x with probability 1 - exp(-K n exp(-lambda x)) (Karlin and Altschul, 1990):
lambda from the clean words' scores, K by maximum likelihood on the clean sample.

Scoring finds all maximal segments of a whole text in one pass (Ruzzo and Tompa, 1999). Those expected less than
E_VALUE times in a clean document of that length are its passages. The best segment's log p-value and the sum of all
passages' log E-values go into a logistic curve fitted on the sample.

Defined results for odd input: null and empty texts have no words and get the score of a document without passages; a model without
both classes gives all documents the share of toxic labels; repeated rows are scored each; a very long text is scored whole, in one pass; a doc_id with several
labels counts as toxic if one says so; an empty table gives no rows; other columns pass through, except those named like the results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_CLASS, MAX_WORDS, MIN_DOCUMENTS = 10_000, 50_000, 3
PRIOR_SHARE, Z, DRIFT, E_VALUE = 0.1, 3.0, 0.15, 0.01
SLICE = 512
WORD = re.compile(r"\w+(?:['’]\w+)*")


def fold(text: str) -> str:
    """Lower case without changing any place in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


PREFIXES = (7, 6, 5, 4)


def units(word: str) -> Iterator[str]:
    """A word, and its beginnings, marked as such: inflected and compound words share these."""
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


class Weights(dict):
    """Weights of words as they come up: that of the longest known unit, or None. Bounded by starting afresh."""

    LIMIT = 500_000

    def __init__(self, known: dict[str, float]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = next((self.known[u] for u in units(word) if u in self.known), None)
        return found


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    seen: Weights | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": None}

    def segments(self, words: list[str]) -> list[tuple[float, int, int]]:
        """All maximal segments (score, first word, end): of their own tokens none scores more without the rest."""
        if self.seen is None:
            self.seen = Weights(self.weights)
        hits = [(i, v) for i, v in enumerate(map(self.seen.__getitem__, words)) if v is not None]
        total, last = 0.0, 0
        # Candidates (sum before, sum with, first, end) with growing sums, each beginning above an earlier one's begin.
        stack: list[tuple[float, float, int, int]] = []
        for i, v in hits:
            total -= DRIFT * (i - last)
            last = i + 1
            before, total = total, total + v - DRIFT
            if v <= DRIFT:
                continue
            left, right, first, end = before, total, i, i + 1
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= left:
                    j -= 1
                if j < 0 or stack[j][1] >= right:
                    break
                left, first = stack[j][0], stack[j][2]
                del stack[j:]
            stack.append((left, right, first, end))
        return [(r - l, a, b) for l, r, a, b in stack]

    def log_e(self, score: float, n: int) -> float:
        return self.log_k + math.log(max(n, 1)) - self.decay * score

    def features(self, segments: list[tuple[float, int, int]], n: int) -> tuple[float, float]:
        """-log p of the best segment, and the sum of -log E of all passages."""
        if not segments:
            return 0.0, 0.0
        e = [self.log_e(s, n) for s, *_ in segments]
        best = min(e)
        p = -math.expm1(-math.exp(min(best, 50.0)))
        limit = math.log(E_VALUE)
        return min(-math.log(p) if p > 1e-300 else -best, 200.0), min(sum(-x for x in e if x < limit), 1000.0)

    def score(self, features: tuple[float, float]) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(features[0]) + c * math.log1p(features[1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios and their z-scores under the informative Dirichlet prior."""
    prior = PRIOR_SHARE * (toxic + clean)
    both = PRIOR_SHARE * (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    ratio = np.log(a / (n_toxic + both - a)) - np.log(b / (n_clean + both - b))
    return ratio, ratio / np.sqrt(1 / a + 1 / b)


def decay_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(x * scores)) = 1, by halving."""
    def over(x: float) -> bool:
        return float((shares * np.exp(np.minimum(x * scores, 500))).sum()) > 1
    high = 1.0
    while not over(high) and high < 64:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(low, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the penalized likelihood; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): distinct texts of at most SAMPLE_PER_CLASS labelled documents of each class. labels: doc_id, toxic."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    few = one.where("toxic").orderBy(*order).limit(SAMPLE_PER_CLASS).union(one.where("not toxic").orderBy(*order).limit(SAMPLE_PER_CLASS))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _each_text(texts: pa.Array) -> list[str]:
    return pc.fill_null(texts, "").to_pylist()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents; only the columns doc_id, text and toxic are looked at."""
    sample = sample_labelled(docs, labels).cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, is_toxic in zip(_each_text(batch.column(0)), batch.column(1).to_pylist()):
                found = {u for w in set(WORD.findall(fold(text))) for u in units(w)}
                (toxic if is_toxic else clean).update(found)
        words = list(toxic.keys() | clean.keys())
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[w] for w in part], pa.int64()), pa.array([clean[w] for w in part], pa.int64())], names=["word", "toxic", "clean"])

    try:
        counts = sample.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        n = sample.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
        if not n.toxic or not n.clean:
            share = (n.toxic + 0.5) / (n.toxic + n.clean + 1)
            return Model(curve=(math.log(share / (1 - share)), 0.0, 0.0))
        total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
        # The same formulas as log_odds(), to choose the words in Spark and bring no others here.
        a, b = F.col("toxic") + PRIOR_SHARE * (F.col("toxic") + F.col("clean")), F.col("clean") + PRIOR_SHARE * (F.col("toxic") + F.col("clean"))
        all_words = total.toxic + total.clean
        ratio = F.log(a / (total.toxic + PRIOR_SHARE * all_words - a)) - F.log(b / (total.clean + PRIOR_SHARE * all_words - b))
        z = ratio / F.sqrt(1 / a + 1 / b)
        chosen = counts.where((F.col("toxic") + F.col("clean") >= MIN_DOCUMENTS) & (F.abs(z) >= Z)).orderBy(F.desc(F.abs(z)), "word").limit(MAX_WORDS).collect()
        toxic, clean = (np.array([r[c] for r in chosen], dtype=float) for c in ("toxic", "clean"))
        ratio = log_odds(toxic, clean, total.toxic, total.clean)[0] if chosen else np.zeros(0)
        model = Model({r.word: float(x) for r, x in zip(chosen, ratio)})
        shares = (clean + PRIOR_SHARE * (toxic + clean)) / (total.clean + PRIOR_SHARE * all_words)
        model.decay = decay_rate(np.append(ratio, 0.0) - DRIFT, np.append(shares, max(0.0, 1 - shares.sum())))

        def measure(of) -> list:
            """of(segments, number of words), two numbers, and the label of each text."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    words = [WORD.findall(fold(text)) for text in _each_text(batch.column(0))]
                    pairs = [of(model.segments(w), len(w)) for w in words]
                    yield pa.RecordBatch.from_arrays([pa.array([float(p[k]) for p in pairs], pa.float64()) for k in (0, 1)] + [batch.column(1)], names=["x", "y", "toxic"])

            return sample.mapInArrow(run, "x double, y double, toxic boolean").collect()

        tops = [(r.x, r.y) for r in measure(lambda segments, k: (k, max((s for s, *_ in segments), default=0.0))) if not r.toxic]
        model.log_k = math.log(len(tops) / max(1e-300, sum(max(k, 1) * math.exp(-min(model.decay * s, 600)) for k, s in tops)))
        rows = measure(model.features)
        x = np.array([[1.0, math.log1p(r.x), math.log1p(r.y)] for r in rows])
        model.curve = tuple(map(float, logistic(x, np.array([float(r.toxic) for r in rows]))))
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted and passages: an array of (start, end, score, e_value), places in code points."""
    source = docs.drop("score", "predicted", "passages")
    names = source.columns
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())])
    schema = T.StructType(source.schema.fields + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        limit = math.log(E_VALUE)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                scores, passages = [], []
                for text in _each_text(part.column(names.index("text"))):
                    low = fold(text)
                    words = WORD.findall(low)
                    segments = own.segments(words)
                    scores.append(own.score(own.features(segments, len(words))))
                    found = [(s, a, b, e) for s, a, b in segments if (e := own.log_e(s, len(words))) < limit]
                    spans = [m.span() for m in WORD.finditer(low)] if found else []
                    passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "e_value": math.exp(e)} for s, a, b, e in found])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], names=schema.names)

    return source.mapInArrow(run, schema)
