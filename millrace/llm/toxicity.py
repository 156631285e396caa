"""Toxicity: maximum-scoring segment search over token log-odds with Dirichlet priors, calibrated by extreme values.

Fitting counts, over all labelled training texts, in how many texts of each label a token occurs. A token's log-odds
compare its rates in toxic and other texts under an informative Dirichlet prior: the prior counts of a word are the
rates of its stem (its first five characters), and those of a stem the rates of the whole vocabulary, each with a
fixed weight, so a rare word of a toxic stem is known and a rare word of no stem is not. Tokens whose log-odds are Z
standard deviations from zero, and above LEAST or below zero, score their log-odds; every other token, of which nothing
is known, scores a constant loss.

Scoring scans each whole text once, in linear time, for all maximal segments of positive total (the algorithm of
Ruzzo and Tompa). A segment of total S in a text of n tokens has the extreme-value tail 1 - exp(-K n exp(-lambda S)).
Both parameters come from the same scan of the training texts that are not toxic: lambda solves sum p(s) exp(lambda s)
= 1 over the scores of all their tokens, and K is the maximum-likelihood estimate from their best segments (texts
without one count as censored at the least score). Segments of p <= ALPHA are the toxic passages. The text's evidence
is the sum of -log p over its passages, and a logistic curve fitted on the training texts' evidence turns it into a
probability.

All tokens that qualify are in the model; their number grows with the vocabulary of the labelled texts alone.

Defined cases: null or empty text has no token and gets the score of no evidence; rows are scored one by one, so
repeated rows, ties and null ids need no rule there (a null id is not held out and its label unknown); without labels of
both kinds every text scores 0.5; other columns are ignored and may have any name. Exact copies of a training text
count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, discard, stored

STEM = 5
#: Weights of the priors: of a stem's rates on a word, of the vocabulary's on a stem.
WORD_PRIOR, STEM_PRIOR = 2.0, 4.0
#: A token scores if its log-odds exceed LEAST and are Z standard deviations above zero, or as many below.
LEAST, Z = 2.5, 4.0
LOSS = 0.5
ALPHA = 0.01

_WORDS = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    lam: float = 1.0
    k: float = 0.3
    slope: float = 1.0
    offset: float = 0.0

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, score) of the words that score."""
        get, stem, out = self.words.get, self.stems, []
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                s = stem.get(w[:STEM])
            if s is not None:
                out.append((i, s))
        return out

    def tail(self, total: float, n: int) -> float:
        """The probability that a text of n tokens that is not toxic has a segment of this total."""
        return float(max(-np.expm1(-self.k * n * np.exp(-self.lam * total)), 1e-300))

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant maximal segments (start, end, total, p) of a text's words."""
        found = [(a, b, float(t), self.tail(t, len(words))) for a, b, t in maximal_segments(self.hits(words), LOSS)]
        return [x for x in found if x[3] <= ALPHA]

    def evidence(self, words: list[str]) -> float:
        return float(sum(-np.log(p) for _, _, _, p in self.segments(words)))

    def probability(self, evidence: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -40, 40))))


def maximal_segments(hits: list[tuple[int, float]], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, total) where the words at `hits` score and all others lose `loss`.

    Ruzzo and Tompa's scan: a stack of candidate segments with the cumulative totals at their left and right ends.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before start, total at end, and the
    total, last = 0.0, -1  # nearest entry below with a smaller total before its start
    for i, s in hits:
        total -= loss * (i - last - 1)
        if s <= 0:  # no segment begins or ends with it
            total, last = total + s, i
            continue
        left, right, start, end = total, total + s, i, i + 1
        total, last = right, i
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]  # all between have a total no smaller
            if k < 0 or stack[k][3] >= right:
                stack.append((start, end, left, right, k))
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, r - lo) for a, b, lo, r, _ in stack]


def _odds_columns(counts: DataFrame, n_toxic: int, n_other: int, prior_toxic: Column, prior_other: Column) -> DataFrame:
    a = F.col("k") + prior_toxic
    b = F.col("n") - F.col("k") + prior_other
    odds = F.log(a / n_toxic) - F.log(b / n_other)
    return counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b))


def solve_lambda(rates: list[tuple[float, float]], loss: float) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1, where the given (score, rate) leave the rest of the mass at -loss."""
    rest = 1.0 - sum(p for _, p in rates)
    if rest <= 0 or sum(p * s for s, p in rates) >= loss * rest:
        return 0.05  # not negative on average: hardly anything is significant
    score, rate = (np.array(x, float) for x in zip(*rates, (-loss, rest), strict=True))
    f = lambda x: float((rate * np.exp(np.minimum(700.0, x * score))).sum()) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 20:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return float(low)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled documents whose crc32(doc_id as text) mod 3 is not 1, each text once; one of both labels is toxic.

    Written to the shared folder. Only ids and labels are moved, unless they are too many to broadcast.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select("doc_id", "text")
    labelled = docs.join(broadcast_if_small(own, labels.count()), F.col("doc_id") == F.col("__id"))
    once = stored(labelled.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min("doc_id").alias("__id"), F.max("toxic").alias("toxic")), "toxic-train")
    rows = docs.join(broadcast_if_small(once, once.count()), (F.col("doc_id") == F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("h")))
    out = stored(rows.select("text", "toxic"), "toxic-rows")
    discard(once)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    sizes = {r["toxic"]: r["c"] for r in rows.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return Model({}, {}, slope=0.0, offset=0.0)
    each = rows.select("toxic", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    counts = stored(each.groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")), "toxic-counts")
    stems = counts.groupBy(F.substring("w", 1, STEM).alias("stem")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    base_t, base_o = n_toxic / (n_toxic + n_other), n_other / (n_toxic + n_other)
    stems = _odds_columns(stems, n_toxic, n_other, F.lit(STEM_PRIOR * base_t), F.lit(STEM_PRIOR * base_o))
    far = F.abs(F.col("z")) > Z
    good = far & (F.col("odds") > LEAST) & (F.col("k") >= 3)
    stem_good = (good & (F.length("stem") == STEM)).alias("stem_good")
    # a word's prior: WORD_PRIOR texts at its stem's shrunk rates. Only words of a stem or count that can pass are joined.
    stem_rate = (F.col("k") + STEM_PRIOR * base_t) / (F.col("n") + STEM_PRIOR)
    words = counts.where(F.col("k") > 0).withColumn("stem", F.substring("w", 1, STEM)).join(stems.select("stem", stem_rate.alias("rate"), stem_good), "stem")
    words = _odds_columns(words, n_toxic, n_other, WORD_PRIOR * F.col("rate"), WORD_PRIOR * (1 - F.col("rate")))
    found_words = words.where((good & ~F.col("stem_good")) | (far & (F.col("odds") < 0))).select("w", "odds").collect()
    found_stems = stems.where(good & (F.length("stem") == STEM)).select("stem", "odds").collect()
    model = Model({r["w"]: r["odds"] for r in found_words}, {r["stem"]: r["odds"] for r in found_stems})
    out = calibrate(rows, model)
    discard(rows, counts)
    return out


def scanned(rows: DataFrame, model: Model) -> DataFrame:
    """toxic, n (tokens), scores (of the tokens that score) and totals (of the maximal segments) of each training text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, scores, totals = [], [], []
            for t in part.column(1):
                ws = words_of(t.as_py())
                hits = model.hits(ws)
                n.append(len(ws))
                scores.append([s for _, s in hits])
                totals.append([t for _, _, t in maximal_segments(hits, LOSS)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(totals, pa.list_(pa.float64()))], names=["toxic", "n", "scores", "totals"])

    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, n long, scores array<double>, totals array<double>")


def null_parameters(scans: DataFrame, model: Model) -> tuple[float, float]:
    """lambda and K of the extreme-value tail, from the texts that are not toxic."""
    learned = [s for s in {*model.words.values(), *model.stems.values()} if s > 0]
    if not learned:
        return 1.0, 0.3
    null = scans.where("toxic = 0")
    tokens = max(1, null.agg(F.sum("n")).first()[0] or 0)
    seen = {r["s"]: r["c"] for r in null.select(F.explode("scores").alias("s")).groupBy("s").agg(F.count("*").alias("c")).collect()}  # at most one a learned score
    for s in learned:  # half an occurrence more among all learned scores, so that none is impossible
        seen[s] = seen.get(s, 0) + 0.5 / len(learned)
    lam, least = solve_lambda([(s, c / (tokens + 0.5)) for s, c in seen.items()], LOSS), min(learned)
    best = F.greatest(F.coalesce(F.array_max("totals"), F.lit(least)), F.lit(least))
    met, weight = null.agg(F.sum((F.size("totals") > 0).cast("long")), F.sum(F.col("n") * F.exp(-lam * best))).first()
    return lam, ((met or 0) + 0.5) / max(weight or 0.0, 1e-9)


def calibrate(rows: DataFrame, model: Model) -> Model:
    """The tail's parameters, and the logistic curve over log(1 + evidence), fitted on counts of the texts in steps of 0.1."""
    scans = stored(scanned(rows, model), "toxic-scan")
    lam, k = null_parameters(scans, model)
    p = F.transform("totals", lambda t: F.greatest(-F.expm1(-k * F.col("n") * F.exp(-lam * t)), F.lit(1e-300)))
    evidence = F.aggregate(F.filter(p, lambda x: x <= ALPHA), F.lit(0.0), lambda a, x: a - F.log(x))
    got = scans.select("toxic", F.round(F.log1p(evidence), 1).alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).orderBy("x").collect()
    discard(scans)
    x, n, toxic = (np.array([float(r[c]) for r in got]) for c in ("x", "n", "k"))
    a, b = 1.0, float(np.log((toxic.sum() + 1) / (n.sum() - toxic.sum() + 1)))
    for _ in range(60):  # Newton steps with a weak ridge on the slope, which separable data would let grow
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([((toxic - n * p) * x).sum() - 0.05 * a, (toxic - n * p).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        a, b = a + d[0], b + d[1]
    return replace(model, lam=lam, k=k, slope=float(a), offset=float(b))


def evidence_of(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.evidence(words_of(t)) for t in part], dtype="float64")

    return run(text)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, passages: array of (start word, end word, total, p, text)."""
    kind = "score double, passages array<struct<start:int,end:int,total:double,p:double,text:string>>"

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            scores, found = [], []
            for t in part:
                ws = words_of(t)
                segs = model.segments(ws)
                scores.append(model.probability(float(sum(-np.log(p) for *_, p in segs))))
                found.append([{"start": a, "end": b, "total": s, "p": p, "text": " ".join(ws[a:b])} for a, b, s, p in segs])
            yield pd.DataFrame({"score": scores, "passages": found})

    r = docs.select("doc_id", run(F.col("text")).alias("r"))
    return r.select("doc_id", "r.score", "r.passages")


def report(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The contract's columns and the number of toxic passages."""
    p = passages(docs, model)
    return p.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
