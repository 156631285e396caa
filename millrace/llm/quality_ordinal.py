"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(t_k - w . x): one vector of weights over hashed features is shared by all grades, and the
thresholds t_0 < t_1 < ... cut its score into grades. Expected grade and tail probability P(grade >= k) come from the
same score and serve selection.

Features of a whole text, hashed to 2**BITS places: its distinct lower-cased words (together of unit length), the
shapes of its words (case and closing marks) and levels of text ratios (symbols, capitals, repeats, ...). Fitting
takes a sample of rated rows that is bounded in rows and in features, in one executor task; scoring is one pass
without a shuffle.

Defined cases: null or empty text has the features of an empty text; rows are scored one by one, so repeated rows,
ties and null ids need no rule there; in fitting, rows that repeat an id and its features count once and a null id is
not rated; without rated rows, or with a single grade, every document gets that grade (or the top grade) with
certainty; other columns are carried and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored, unused

BITS = 18
#: Rated rows that the model is fitted on at most, those with the smallest hash of the id, and the features (8 bytes
#: each, twice that while fitting) that they may have together; the first row beyond ends the sample.
MAX_RATED = 8_000
MAX_FEATURES = 8_000_000
EPOCHS = 120
RIDGE = 1e-5

_LEVELS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_COUNT_LEVELS = [1, 3, 10, 20, 50, 100, 300, 1000, 3000]
_MASK = (1 << BITS) - 1


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) & _MASK


_LEVEL_PLACES = {name: [_place(f"\x01{name}>{v}") for v in _LEVELS] for name in ("symbols", "upper", "marked", "digits", "narrow", "distinct", "echo", "lines", "bars")}
_COUNT_PLACES = [_place(f"\x01words>{v}") for v in _COUNT_LEVELS]
_BIAS = _place("\x01bias")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of one whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    kinds = set(words)
    low = {w.lower() for w in kinds}
    crc = zlib.crc32
    places = [crc(w.encode()) & _MASK for w in low]
    value = 1.0 / np.sqrt(max(1, len(low)))
    values = [value] * len(places)
    upper = sum(1 for c in kinds if len(c) > 1 and c.isupper())
    marked, shapes = 0, set()
    for w in kinds:
        if not w[-1].isalnum():
            tail = w.rstrip("".join({w[-1]}))
            mark = w[len(tail) :][:3]
            if len(mark) > 1 or mark not in ".,;:?!'\")":
                marked += 1
            shapes.add(f"\x02{'U' if w[:1].isupper() else 'l'}{mark}")
    k = max(1, len(kinds))
    lines = [x for x in text.split("\n") if x.strip()]
    echo = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    ratios = {
        "symbols": sum(text.count(c) for c in "#*$%&|<>{}[]~^_=\\/@") / chars,
        "upper": upper / k,
        "marked": marked / k,
        "digits": sum(text.count(c) for c in "0123456789") / chars,
        "narrow": 1.0 - len(text.encode()) / chars / 4,
        "distinct": len(kinds) / max(1, n),
        "echo": echo / max(1, n),
        "lines": 1.0 - len(set(lines)) / max(1, len(lines)),
        "bars": words.count("|") / max(1, n),
    }
    more = [_BIAS]
    for name, v in ratios.items():
        more += [p for p, at in zip(_LEVEL_PLACES[name], _LEVELS, strict=True) if v > at]
    more += [p for p, at in zip(_COUNT_PLACES, _COUNT_LEVELS, strict=True) if n > at]
    more += [_place(s) for s in shapes]
    return np.array(places + more, np.int64), np.array(values + [1.0] * len(more))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Ordinal:
    """weights over the hashed places, and the ordered thresholds (one fewer than grades)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        places, values = features(text)
        return float(self.weights[places] @ values)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, a row each score."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def fit_rows(texts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, epochs: int = EPOCHS) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood. Thresholds: the first, then positive steps (exponentials)."""
    size = 1 << BITS
    if len(texts) == 0 or n_grades < 2 or len(np.unique(grades)) < 2:
        top = int(grades[0]) if len(grades) else max(1, n_grades - 1)
        return Ordinal(np.zeros(size), np.where(np.arange(max(1, n_grades - 1)) < top, -40.0, 40.0))
    idx = np.concatenate([t[0] for t in texts]).astype(np.int32)
    val = np.concatenate([t[1] for t in texts]).astype(np.float32)
    length = np.array([len(t[0]) for t in texts])
    at = np.r_[0, np.cumsum(length)[:-1]]
    w = np.zeros(size)
    free = np.zeros(n_grades - 1)
    free[0] = np.log((np.mean(grades < 1) + 1e-3) / (1 - np.mean(grades < 1) + 1e-3))
    m, v, mt, vt = np.zeros(size), np.zeros(size), np.zeros_like(free), np.zeros_like(free)
    n = len(grades)
    for epoch in range(1, epochs + 1):
        t = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        edges = np.r_[-1e9, t, 1e9]
        s = np.add.reduceat(val * w[idx], at)
        up, lo = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        p = np.maximum(up - lo, 1e-9)
        dup, dlo = up * (1 - up), lo * (1 - lo)
        gs = (dup - dlo) / p / n  # d(-log p) / ds
        gw = np.bincount(idx, weights=val * np.repeat(gs.astype(np.float32), length), minlength=size) + RIDGE * w
        ge = np.zeros(n_grades + 1)
        np.add.at(ge, grades + 1, -dup / p / n)
        np.add.at(ge, grades, dlo / p / n)
        gt = ge[1:-1]
        gf = np.array([gt[j:].sum() * (1.0 if j == 0 else np.exp(free[j])) for j in range(n_grades - 1)])
        rate = 0.1 / (1 + 0.01 * epoch)
        for g, a, b, x in ((gw, m, v, w), (gf, mt, vt, free)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            x -= rate * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
    return Ordinal(w.astype("float32"), free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rated: int = MAX_RATED, max_features: int = MAX_FEATURES) -> Ordinal:
    """ratings: doc_id, grade (0 .. n_grades - 1). Rows with crc32(doc_id as text) mod 3 = 1 are held out.

    One executor task fits; the driver gets the weights alone. The task holds max_features features at most.
    """
    chosen = (
        ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("grade").cast("int").alias("__grade"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rated)
    )

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [features(t.as_py()) for t in part.column(2)]
            p, v = [p.astype("<i4").tobytes() for p, _ in made], [v.astype("<f4").tobytes() for _, v in made]
            size = pa.array([len(x) // 4 for x in p], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, pa.array(p, pa.binary()), pa.array(v, pa.binary())], names=["id", "grade", "size", "p", "v"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "__grade", "text")
    made = rows.mapInArrow(measure, "id long, grade int, size long, p binary, v binary")
    # a place in the order for each row; rows that repeat (id, features) count once
    made = stored(made.withColumn("at", F.struct(F.xxhash64("id").alias("h"), "id", F.xxhash64("p", "v").alias("f"))), "rated")
    first = made.groupBy("at").agg(F.max("size").alias("size")).orderBy("at").limit(max_rated)
    total = first.select("at", F.sum("size").over(Window.orderBy("at")).alias("total"))  # of max_rated rows at most
    last = total.where(F.col("total") <= max_features).agg(F.max("at").alias("at")).collect()[0]["at"]
    if last is None:
        return fit_rows([], np.zeros(0, np.int64), n_grades)
    once = made.where(F.col("at") <= F.struct(*[F.lit(x).cast("bigint") for x in last])).dropDuplicates(["at"])

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, texts = [], []
        for part in parts:
            grades.append(part.column("grade").to_numpy())
            texts += [(np.frombuffer(p.as_py(), "<i4"), np.frombuffer(v.as_py(), "<f4")) for p, v in zip(part.column("p"), part.column("v"), strict=True)]
        model = fit_rows(texts, np.concatenate([np.zeros(0, np.int64), *grades]).astype(np.int64), n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["w", "t"])

    got = once.select("at", "grade", "p", "v").coalesce(1).sortWithinPartitions("at").select("grade", "p", "v").mapInArrow(train, "w binary, t array<double>").collect()
    discard(made)
    return Ordinal(np.frombuffer(got[0]["w"], "<f4"), np.array(got[0]["t"]))


def graded(labels: DataFrame) -> DataFrame:
    """Three grades from two marks: 0 junk (quality 0), 1 sound but toxic, 2 sound and civil; rows without a quality have none."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def rate(text: Column, model: Ordinal, spark) -> Column:
    """A struct (expected_grade, tail): the expected grade, and P(grade >= 1)."""
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Ordinal(*shared.value)
        for part in parts:
            tails = m.tails(np.array([m.score(t) for t in part], float).reshape(-1))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, 0]})

    return run(text)


def classify(docs: DataFrame, model: Ordinal, least_tail: float = 0.5, least_expected: float = 0.0) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept: one row per row of docs. Kept are rows that reach both bounds."""
    rated = docs.select("doc_id", rate(F.col("text"), model, docs.sparkSession).alias("r"))
    kept = (F.col("r.tail") >= least_tail) & (F.col("r.expected_grade") >= least_expected)
    return rated.select("doc_id", F.col("r.expected_grade").alias("expected_grade"), F.col("r.tail").alias("tail_probability"), kept.alias("kept"))


def keep_good(docs: DataFrame, model: Ordinal, least_tail: float = 0.5, least_expected: float = 0.0) -> DataFrame:
    """The rows of docs whose tail probability P(grade >= 1) and expected grade reach the bounds."""
    name = unused(docs, "rated")
    rated = docs.withColumn(name, rate(F.col("text"), model, docs.sparkSession))
    return rated.where((F.col(name)["tail"] >= least_tail) & (F.col(name)["expected_grade"] >= least_expected)).drop(name)
