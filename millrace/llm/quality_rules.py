"""Quality rules: ordered decision lists learned by sequential covering from labelled statistics of texts.

`text_stats` measures every whole text. `learn_rules` grows conjunctions of thresholds on a growing set (each added
condition is the one with the largest information gain), prunes their tail on a pruning set, keeps a rule while it is
precise there, removes the rows it covers and starts again. `verdict` turns the list into one ordered CASE expression.

Defined cases: null or empty text has no words, zero in every statistic and fails the base rules; rows are judged
one by one, so repeated rows, ties and null ids need no rule of their own; without labelled rows, or with one class
only, the list is empty and rejects nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a list is learned from at most: those with the smallest hash of the id.
MAX_LABELLED = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Statistic names; those of BASE are the contract's, the rest are further inputs of the rules.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_distinct_words", "n_marked_words"]

#: Ratios that the rules compare with thresholds: name -> (numerator, denominator).
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_words_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "distinct_words_share": ("n_distinct_words", "n_words"),
    "marked_words_share": ("n_marked_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def stats_of(text: str | None) -> tuple[int, ...]:
    """BASE and MORE of one text. Words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    raw = text.encode("utf-8")
    words = raw.split()  # on exactly the bytes 09-0D and 20
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    ids = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    repeat = 0
    if n >= 2 and len(ids) < n and n > WINDOW:
        h = np.fromiter((ids[w] for w in words), np.uint64, n)
        k = n - WINDOW + 1
        mix = np.zeros(k, np.uint64)
        for j in range(WINDOW):  # a polynomial over the words' hashes, modulo 2**64
            mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[j : j + k]
            mix ^= mix >> np.uint64(29)
        order = np.argsort(mix, kind="stable")
        same = mix[order][1:] == mix[order][:-1]
        if same.any():
            twice = np.zeros(k, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    if text.isascii():
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
        upper, letters = int(counts[65:91].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    else:
        chars = Counter(text)
        upper, letters = sum(k for c, k in chars.items() if c.isupper()), sum(k for c, k in chars.items() if c.isalpha())
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!'\")")
    return (n, len(text) - spaces, symbols, dup, repeat, lines, upper, letters, len(ids), marked)


STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in BASE + MORE])


@F.pandas_udf(STATS_TYPE)
def _stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([stats_of(t) for t in part], columns=BASE + MORE, dtype="int64")


def text_stats(text: Column) -> Column:
    """A struct of BASE and MORE."""
    return _stats(text)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))


def _foil_step(x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[float, int, bool, float] | None:
    """The (gain, feature, above, threshold) that adds most information about the rejected rows inside the rule."""
    p0, n0 = int((y & inside).sum()), int((~y & inside).sum())
    if not p0 or not n0:
        return None
    before, best = np.log2(p0 / (p0 + n0)), None
    for f in range(x.shape[1]):
        v, lab = x[inside, f], y[inside]
        order = np.argsort(v, kind="stable")
        v, lab = v[order], lab[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between distinct values alone
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(lab)[cut], np.cumsum(~lab)[cut]
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def _covers(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.name)]
        inside &= (v > c.at) if c.above else (v <= c.at)
    return inside


def learn_rules(x: np.ndarray, reject: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5, most: int = 16) -> list[list[Condition]]:
    """Rules whose rows are rejected, in order. Two thirds of the rows grow a rule, one third prunes and judges it."""
    y = reject.astype(bool)
    part = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~part], y[~part], x[part], y[part]
    rules: list[list[Condition]] = []
    while len(rules) < most and gy.any():
        rule: list[Condition] = []
        while len(rule) < 4 and (step := _foil_step(gx, gy, _covers(gx, names, rule))):
            rule.append(Condition(names[step[1]], step[2], step[3]))
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            c = _covers(px, names, r)
            p, n = int((py & c).sum()), int((~py & c).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and max((worth(rule[:k]), -k) for k in range(1, len(rule)))[0] >= worth(rule):
            rule = rule[: -max((worth(rule[:k]), -k) for k in range(1, len(rule)))[1]]
        grown, pruned = _covers(gx, names, rule), _covers(px, names, rule)
        hits, wrong = int((py & pruned).sum()), int((~py & pruned).sum())
        if hits + wrong == 0 or hits < precision * (hits + wrong) or int((gy & grown).sum()) < least:
            break
        rules.append(rule)
        gx, gy, px, py = gx[~grown], gy[~grown], px[~pruned], py[~pruned]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fits (from 1), or null."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for c in rule:
            fits = fits & ((ratio(c.name) > c.at) if c.above else (ratio(c.name) <= c.at))
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learn the list from at most max_labelled labelled rows (quality 0 is rejected) outside the held-out third."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    got = rows.select("doc_id", F.col("__y"), text_stats(F.col("text")).alias("s")).select("doc_id", "__y", "s.*")
    got = got.select("doc_id", "__y", *[ratio(n).alias(n) for n in RATIOS]).toPandas()
    if got.empty or got["__y"].nunique() < 2:
        return []
    got = got.sort_values(["doc_id", *RATIOS], kind="stable")
    return learn_rules(got[list(RATIOS)].to_numpy("float64"), (got["__y"] == 0).to_numpy(), list(RATIOS))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, base_failed, rule (first that fits, or null), kept."""
    s = docs.select("doc_id", text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    s = s.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    s = s.withColumn("rule", verdict(rules).cast("int"))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
