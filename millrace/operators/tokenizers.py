"""Tokenizers: words, characters, BPE, WordPiece, Unigram. Training counts words once on the cluster and learns on all
distinct words: their table stays distributed, the driver gets counts of pairs, pieces and characters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.ordering import numbered
from millrace.storage import discard, stored

#: Pair counts that the driver holds after a count of all; rarer pairs are counted anew if their turn can come.
MAX_PAIRS = 100_000
#: Merges after which the table of words is written with them applied.
PENDING = 24
#: Parts that an expected count is summed in.
UNIT = 1 << 20
#: Words that are taken apart at once, and distinct words whose pieces a task remembers.
WORDS, MEMO = 100_000, 100_000
END = "</w>"
SPACE = "▁"


WORD_V2 = rf"([\p{{L}}\p{{N}}_]+(?:'[\p{{L}}\p{{N}}_]+)?|[^\p{{L}}\p{{N}}_{X.WS}])"


def words_v1(text: Column) -> Column:
    """Runs of letters, digits and underscores, and the marks . , ! ? ;"""
    return F.regexp_extract_all(X.normalise(text), F.lit(r"([\p{L}\p{N}_]+|[.,!?;])"), F.lit(1))


def words_v2(text: Column) -> Column:
    """Words with one contraction each, and every other character that is not white space by itself."""
    return F.regexp_extract_all(X.normalise(text), F.lit(WORD_V2), F.lit(1))


def characters(text: Column) -> Column:
    return F.filter(F.split(X.normalise(text), ""), lambda c: F.length(c) > 0)


def vocabulary(tokens: DataFrame, specials: tuple[str, ...] = ("<pad>", "<unk>"), token: str = "token") -> DataFrame:
    """(token, id): the special tokens first, then all others in order, numbered range by range."""
    got = tokens.select(F.col(token).alias("token")).where(~F.col("token").isin(*specials)).distinct()
    ids = numbered(got, "token", "id", len(specials)).withColumn("id", F.col("id").cast("int"))
    first = tokens.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    return first.unionByName(ids)


def encode(tokens: DataFrame, vocab: DataFrame, key: str, unknown: int = 1) -> DataFrame:
    """(key, ord, id) of tokens (key, ord, token); unknown tokens get one id."""
    return tokens.join(vocab, "token", "left").select(key, "ord", F.coalesce("id", F.lit(unknown)).alias("id"))


def word_counts(docs: DataFrame, text: str = "text", words: Column | None = None) -> DataFrame:
    """(word, n) of all texts; words: an array of words, those of `words_v2` if not given. The words of a batch of texts are counted together before anything is shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            met = part.column(0).flatten().value_counts()
            if len(met):
                yield pa.RecordBatch.from_arrays([met.field(0).cast(pa.string()), met.field(1).cast(pa.int64())], names=["word", "n"])

    # white space is no word: it need not be squeezed first
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_V2), F.lit(1)) if words is None else words
    return docs.select(F.coalesce(words, F.array().cast("array<string>")).alias("ws")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_stats(counts: DataFrame) -> DataFrame:
    """(left, right, n): adjacent symbols of words ending in </w>, weighted by the words' counts."""
    symbols = F.concat(F.filter(F.split("word", ""), lambda c: F.length(c) > 0), F.array(F.lit(END)))
    pairs = F.zip_with(F.slice(F.col("s"), F.lit(1), F.size("s") - 1), F.slice(F.col("s"), F.lit(2), F.size("s") - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return counts.select("n", symbols.alias("s")).select("n", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def train_bpe(counts: dict[str, int], merges: int) -> list[tuple[str, str]]:
    """The merges in order: most frequent pair first, ties by the smaller (left, right). Only words with the pair are touched."""
    words = [[*w, END] for w in counts]
    n = list(counts.values())
    stats: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = {}
    for i, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            stats[p] += n[i]
            where.setdefault(p, set()).add(i)
    out = []
    while len(out) < merges and stats:
        best = min(stats, key=lambda p: (-stats[p], p))
        if stats[best] <= 0:
            break
        out.append(best)
        for i in where.pop(best, set()):
            w = words[i]
            for p in zip(w, w[1:], strict=False):
                stats[p] -= n[i]
            words[i] = w = merge(w, best)
            for p in zip(w, w[1:], strict=False):
                stats[p] += n[i]
                where.setdefault(p, set()).add(i)
        stats.pop(best, None)
    return out


#: Symbols of different parts of words that one task learns on; more are learned on by rounds over all words.
FLAT = 6_000_000
#: Places of a table of pairs that a task counts in; with more symbols pairs are sorted.
TABLE = 16_000_000
_END_POINT = 0x110000  # no character


def learn_bpe(counts: DataFrame, merges: int) -> list[tuple[str, str]]:
    """As train_bpe, over a distributed table (word, n) of any size.

    A merged pair is no more frequent than the two characters that meet in it. So words are cut where these are rarer than
    all merges turn out to be, and equal parts are put together: few are left, on which one task learns. Where it reaches
    a pair as rare as those that were cut, rarer ones are kept; where too many parts are left, rounds take over.
    """
    words = stored(counts.select("word", F.col("n").cast("long").alias("n")), "bpe-counts")
    got = _learn_on_parts(words, merges)
    got = _learn_by_rounds(words, merges) if got is None else got
    discard(words)
    return got


def _laid_out(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of a batch of words (word, n) with an end after each, the pairs of every place and the next, and the words' counts there."""
    words = part.column(0).to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    out = np.full(int(sizes.sum()), _END_POINT, np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    pairs = np.where(inner, out << 21 | np.r_[out[1:], 0], -1)
    return out, pairs, np.repeat(part.column(1).to_numpy(), sizes)


def _learn_on_parts(words: DataFrame, merges: int) -> list[tuple[str, str]] | None:
    """learn_bpe of a stored table, or None if too many parts of words are left."""

    def meeting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            _, pairs, n = _laid_out(part)
            p, at = np.unique(pairs[pairs >= 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.bincount(at, n[pairs >= 0], len(p)).astype(np.int64))], names=["p", "n"])

    met = stored(words.mapInArrow(meeting, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")), "bpe-meeting")
    most = max(64, 2 * merges)
    while True:
        rows = met.orderBy(F.desc("n"), "p").limit(most + 1).collect()
        least = rows[most]["n"] + 1 if len(rows) > most else 1
        keep = np.array(sorted(r["p"] for r in rows if r["n"] >= least), np.int64)

        def cut(parts: Iterator[pa.RecordBatch], keep=keep) -> Iterator[pa.RecordBatch]:
            for part in parts:
                out, pairs, n = _laid_out(part)
                starts = np.flatnonzero(~np.r_[False, np.isin(pairs, keep)[:-1]])
                ends = np.r_[starts[1:], len(out)]
                text, sums = out.astype("<u4").tobytes(), Counter()
                for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                    sums[text[4 * a : 4 * b]] += int(n[a])
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["s", "n"])

        def learn(parts: Iterator[pa.RecordBatch], least=least) -> Iterator[pa.RecordBatch]:
            got = _merges_of_parts([(s, n) for part in parts for s, n in zip(*(c.to_pylist() for c in part.columns), strict=True)], merges, least)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int64()), *(pa.array(list(c), pa.string()) for c in (zip(*got, strict=True) if got else ([], [])))], names=["k", "left", "right"])

        cuts = stored(words.mapInArrow(cut, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n")), "bpe-parts")
        fits = (cuts.agg(F.sum(F.length("s") / 4 + 1)).first()[0] or 0) <= FLAT
        got = [(r["left"], r["right"]) for r in cuts.coalesce(1).mapInArrow(learn, "k long, left string, right string").orderBy("k").collect()] if fits else []
        discard(cuts)
        if not fits or any(x + y == END for x, y in got):  # what spells the end mark would meet with other characters than its own
            discard(met)
            return None
        if len(got) == merges or least == 1:
            discard(met)
            return got
        most *= 4


def _merges_of_parts(parts: list[tuple[bytes, int]], merges: int, least: int) -> list[tuple[str, str]]:
    """train_bpe of parts of words as (characters of four bytes, n), as long as the best pair has a count of `least` or more."""
    if not parts:
        return []
    sizes = np.array([len(s) // 4 for s, _ in parts])
    points = np.frombuffer(b"".join(s for s, _ in parts), "<u4")
    known, own = np.unique(points, return_inverse=True)
    names = [END if p == _END_POINT else chr(p) for p in known.tolist()]
    ids = {x: k for k, x in enumerate(names)}
    s = np.full(len(points) + len(parts), -1, np.int64)  # -1 stands after every part
    s[np.arange(len(points)) + np.repeat(np.arange(len(parts)), sizes)] = own
    w = np.repeat(np.array([n for _, n in parts], np.float64), sizes + 1)
    width = len(names) + merges
    out: list[tuple[str, str]] = []
    while len(out) < merges and len(s) > 1:
        codes = np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] * width + s[1:], width * width)
        if width * width < TABLE:
            table = np.bincount(codes, w[:-1], width * width + 1)[:-1]
            best = table.max()
            tied = np.flatnonzero(table == best)
        else:
            found, at = np.unique(np.r_[codes, width * width], return_inverse=True)
            table = np.bincount(at, np.r_[w[:-1], 0])[:-1]
            best = table.max(initial=0)
            tied = found[:-1][table == best]
        if best < max(least, 1):
            break
        x, y = min((names[k // width], names[k % width]) for k in tied.tolist())
        out.append((x, y))
        new = ids.setdefault(x + y, len(names))
        if new == len(names):
            names.append(x + y)
        hit = np.flatnonzero((s[:-1] == ids[x]) & (s[1:] == ids[y]))
        if x == y:  # of a run every second one, from the left
            first = np.r_[True, np.diff(hit) != 1]
            hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
        s[hit] = new
        left = np.ones(len(s), bool)
        left[hit + 1] = False
        s, w = s[left], w[left]
    return out


def _learn_by_rounds(counts: DataFrame, merges: int) -> list[tuple[str, str]]:
    """learn_bpe by rounds over a table of all words.

    A word is a string of its symbols, each between a space and a line end, which no word has. The driver holds the
    counts of the most frequent pairs. A round merges the best pairs as long as the next one shares no symbol with those
    before it and is ahead of all that do (what they become is no more frequent), and collects the change of the counts
    from the words that have one of them.
    """
    symbols = F.concat(F.regexp_replace("word", "(?s)(.)", " $1\n"), F.lit(f" {END}\n"))
    base = stored(counts.select(F.concat("word", F.lit(END)).alias("w"), symbols.alias("s"), F.col("n").cast("long").alias("n")), "bpe-words")
    pending: list[tuple[str, str]] = []

    def merged(s: Column, some: list[tuple[str, str]]) -> Column:
        for x, y in some:
            s = F.replace(s, F.lit(f" {x}\n {y}\n"), F.lit(f" {x}{y}\n"))
        return s

    def pairs(s: Column) -> Column:
        def of(v: Column) -> Column:
            last = F.size(v) - 1
            return F.zip_with(F.slice(v, F.lit(1), last), F.slice(v, F.lit(2), last), lambda x, y: F.struct(x.alias("left"), y.alias("right")))

        # the symbols are bound to a variable: as an expression they would be split twice
        return F.flatten(F.transform(F.array(F.split(F.substr(s, F.lit(2), F.length(s) - 2), "\n ")), of))

    def summed(each: DataFrame) -> DataFrame:
        return each.select("n", F.explode("ps").alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n")).where("n <> 0")

    def count() -> tuple[dict[tuple[str, str], int], int]:
        """The most frequent pairs, and the count that no other pair exceeds."""
        rows = summed(base.select("n", pairs(merged(F.col("s"), pending)).alias("ps"))).orderBy(F.desc("n"), "left", "right").limit(MAX_PAIRS).collect()
        return {(r["left"], r["right"]): r["n"] for r in rows}, rows[-1]["n"] if len(rows) == MAX_PAIRS else 0

    stats, floor = count()
    out: list[tuple[str, str]] = []
    while len(out) < merges:
        order = lambda p: (-stats[p], p)
        best = nsmallest(64, stats, key=order)
        if floor and (not best or stats[best[0]] <= floor):
            stats, floor = count()
            best = nsmallest(64, stats, key=order)
        now: list[tuple[str, str]] = []
        touched: set[str] = set()
        for k, p in enumerate(best[:-1] if len(stats) > 64 else best):
            rivals = (q for q in best[k:] if stats[q] == stats[p])
            if len(out) + len(now) == merges or stats[p] <= 0 or now and (stats[p] <= floor or stats[best[-1]] == stats[p] or any(touched & set(q) for q in rivals)):
                break
            now.append(p)
            touched |= {*p, p[0] + p[1]}
        if not now:
            break
        out += now
        if len(out) == merges:
            break
        # few words have what the pairs spell: only these get the merges that are not written yet, and are looked into
        spelt, hit = F.lit(False), F.lit(False)
        for x, y in now:
            spelt |= F.contains("w", F.lit(x + y))
            hit |= F.contains("s", F.lit(f" {x}\n {y}\n"))
        words = base.where(spelt).select(merged(F.col("s"), pending).alias("s"), "n")
        sides = F.array(F.struct("s", (-F.col("n")).alias("n")), F.struct(merged(F.col("s"), now).alias("s"), "n"))
        change = summed(words.where(hit).select(F.explode(sides).alias("w")).select("w.n", pairs(F.col("w.s")).alias("ps")))
        known = {x + y for x, y in out}
        for r in change.collect():
            p = (r["left"], r["right"])
            if p in stats or not floor or p[0] in known or p[1] in known:
                stats[p] = stats.get(p, 0) + r["n"]
                if stats[p] <= 0:
                    del stats[p]
        pending += now
        if len(pending) >= PENDING:
            old, base = base, stored(base.select("w", merged(F.col("s"), pending).alias("s"), "n"), "bpe-words")
            discard(old)
            pending = []
        if floor and any(x + y == END or len(x + y) == 1 for x, y in now):
            stats, floor = count()
    discard(base)
    return out


def merge(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """All occurrences of a pair that do not overlap, from the left."""
    out, k = [], 0
    while k < len(symbols):
        if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair:
            out.append(symbols[k] + symbols[k + 1])
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


def bpe_word(word: str, ranks: dict[tuple[str, str], int], longest_first: bool = False) -> list[str]:
    """By the lowest merge rank, or by the longest result (ties: learned first); a bare end mark is dropped."""
    s = [*word, END]
    while len(s) > 1:
        pairs = [p for p in set(zip(s, s[1:], strict=False)) if p in ranks]
        if not pairs:
            break
        s = merge(s, min(pairs, key=lambda p: (-len(p[0] + p[1]), ranks[p]) if longest_first else ranks[p]))
    return [t for t in s if t != END]


def wordpieces(counts: dict[str, int], size: int = 10_000) -> set[str]:
    """Characters and ## characters seen, then the most frequent words, prefixes and ## suffixes up to a size."""
    chars = Counter()
    cand: Counter = Counter()
    for w, n in counts.items():
        chars[w[0]] += n
        for c in w[1:]:
            chars["##" + c] += n
        for k in range(2, min(len(w), 20) + 1):
            cand[w[:k]] += n
            if k < len(w):
                cand["##" + w[k:]] += n
    vocab = set(chars)
    for piece, _ in sorted(cand.items(), key=lambda x: (-x[1], x[0])):
        if len(vocab) >= size:
            break
        vocab.add(piece)
    return vocab


def learn_wordpieces(counts: DataFrame, size: int = 10_000) -> set[str]:
    """As wordpieces, over a distributed table (word, n) of any size."""
    long = F.length("word") > 1
    own = F.array(F.substring("word", 1, 1))
    rest = F.when(long, F.transform(F.filter(F.split(F.substr("word", F.lit(2)), ""), lambda c: F.length(c) > 0), lambda c: F.concat(F.lit("##"), c))).otherwise(F.array().cast("array<string>"))
    chars = {r["c"] for r in counts.select(F.explode(F.concat(own, rest)).alias("c")).distinct().collect()}
    cuts = F.sequence(F.lit(2), F.least(F.length("word"), F.lit(20)))
    heads = F.transform(cuts, lambda k: F.substr("word", F.lit(1), k))
    tails = F.transform(F.filter(cuts, lambda k: k < F.length("word")), lambda k: F.concat(F.lit("##"), F.substr("word", k + 1)))
    cand = counts.where(long).select("n", F.explode(F.concat(heads, tails)).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))
    # pieces that are characters too add nothing: no more than size + their number can be looked at
    vocab = set(chars)
    for r in cand.orderBy(F.desc("n"), "piece").limit(size + len(chars)).collect():
        if len(vocab) >= size:
            break
        vocab.add(r["piece"])
    return vocab


def wordpiece_word(word: str, vocab: set[str], unknown: str = "<unk>") -> list[str]:
    """Greedy longest match from the left; a character without a piece is unknown and passed over."""
    if word in vocab:
        return [word]
    out, k = [], 0
    while k < len(word):
        for end in range(len(word), k, -1):
            piece = ("##" if k else "") + word[k:end]
            if piece in vocab:
                out.append(piece)
                k = end
                break
        else:
            out.append(unknown)
            k += 1
    return out


def train_unigram(counts: dict[str, int], size: int = 2_000, rounds: int = 5, longest: int = 8) -> dict[str, float]:
    """Piece log-probabilities: expected counts over all segmentations (forward and backward sums), pruned to a size each round."""
    cand: Counter = Counter()
    for w, n in counts.items():
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                cand[w[i:j]] += n
    chars = {c for w in counts for c in w}
    keep = chars | {p for p, _ in sorted(cand.items(), key=lambda x: (-x[1] * len(x[0]), x[0]))[: size * 4]}
    total = sum(cand[p] for p in keep)
    score = {p: log(cand[p] / total) for p in keep}
    for r in range(rounds):
        expected: Counter = Counter()
        for w, n in counts.items():
            f = [1.0] + [0.0] * len(w)
            for j in range(1, len(w) + 1):
                f[j] = sum(f[i] * exp(score[w[i:j]]) for i in range(max(0, j - longest), j) if w[i:j] in score)
            b = [0.0] * len(w) + [1.0]
            for i in range(len(w) - 1, -1, -1):
                b[i] = sum(exp(score[w[i:j]]) * b[j] for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in score)
            if f[-1] > 0:
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + longest) + 1):
                        if w[i:j] in score:
                            expected[w[i:j]] += n * f[i] * exp(score[w[i:j]]) * b[j] / f[-1]
        goal = max(size, int(size * 4 * (1 - (r + 1) / rounds)))
        best = [p for p, _ in sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:goal]]
        kept = set(best) | chars
        total = sum(max(expected[p], 1e-6) for p in kept)
        score = {p: log(max(expected[p], 1e-6) / total) for p in kept}
    return score


def learn_unigram(counts: DataFrame, size: int = 2_000, rounds: int = 5, longest: int = 8) -> dict[str, float]:
    """As train_unigram, over a distributed table (word, n) of any size.

    Expected counts are summed as whole multiples of 1 / UNIT, so that the result does not depend on the order of the sums.
    """
    counts = stored(counts.select("word", "n"), "unigram-words")
    spark = counts.sparkSession
    at = F.sequence(F.lit(1), F.length("word"))
    pieces = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda k: F.substr("word", i, k))))
    cand = stored(counts.select("n", F.explode(pieces).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n")), "unigram-pieces")
    first = {r["piece"]: r["n"] for r in cand.where(F.length("piece") == 1).collect()}
    chars = set(first)
    first |= {r["piece"]: r["n"] for r in cand.orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(size * 4).collect()}
    discard(cand)
    total = sum(first.values())
    score = {p: log(n / total) for p, n in first.items()}
    for r in range(rounds):
        sent = spark.sparkContext.broadcast({p: exp(x) for p, x in score.items()})

        def expect(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            prob = sent.value
            units: dict[str, int] = {}
            for part in parts:
                for w, n in zip(part["word"].tolist(), part["n"].tolist(), strict=True):
                    end = len(w)
                    arcs = []
                    f = [1.0] + [0.0] * end
                    for i in range(end):
                        for j in range(i + 1, min(end, i + longest) + 1):
                            p = prob.get(piece := w[i:j])
                            if p is not None:
                                arcs.append((i, j, p, piece))
                                f[j] += f[i] * p
                    if f[-1] > 0:
                        b = [0.0] * end + [1.0]
                        for i, j, p, piece in reversed(arcs):
                            b[i] += p * b[j]
                            units[piece] = units.get(piece, 0) + round(n * f[i] * p * b[j] / f[-1] * UNIT)
            if units:
                yield pd.DataFrame({"piece": list(units), "units": list(units.values())})

        expected = {x["piece"]: x["units"] / UNIT for x in counts.mapInPandas(expect, "piece string, units long").groupBy("piece").agg(F.sum("units").alias("units")).collect()}
        sent.destroy()
        goal = max(size, int(size * 4 * (1 - (r + 1) / rounds)))
        best = [p for p, _ in sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:goal]]
        kept = set(best) | chars
        total = sum(max(expected.get(p, 0.0), 1e-6) for p in sorted(kept))
        score = {p: log(max(expected.get(p, 0.0), 1e-6) / total) for p in kept}
    discard(counts)
    return score


def unigram_word(word: str, score: dict[str, float], unknown: str = "<unk>", longest: int = 8) -> list[str]:
    """The segmentation of the highest sum of log-probabilities; characters without a piece are unknown."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            s = score.get(word[i:j], -50.0 if j == i + 1 else None)
            if s is not None and best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i)
    out, j = [], len(word)
    while j:
        i = best[j][1]
        out.append(word[i:j] if word[i:j] in score else unknown)
        j = i
    return out[::-1]


def apply_words(words: Column, one) -> Column:
    """A word tokenizer over arrays of words, each distinct word of a batch once."""

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, list[str]] = {}
        known: dict[str, str] = {}  # a piece is held once, however many words have it
        for part in parts:
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if len(memo) > MEMO:
                    memo.clear()
                    known.clear()
                out = []
                for ws in part.slice(a, b - a).to_pylist():
                    pieces: list[str] = []
                    for w in ws or []:
                        got = memo.get(w)
                        if got is None:
                            got = memo[w] = [known.setdefault(x, x) for x in one(w)]
                        pieces += got
                    out.append(pieces)
                yield pa.array(out, pa.list_(pa.string()))

    return run(words)


def with_spaces(text: Column) -> Column:
    """Words that begin with the space mark, as in sentence-wise tokenizers."""
    return F.transform(X.words(F.lower(text)), lambda w: F.concat(F.lit(SPACE), w))


def decode(tokens: Column) -> Column:
    return F.trim(F.replace(F.replace(F.array_join(tokens, ""), F.lit(END), F.lit(" ")), F.lit(SPACE), F.lit(" ")))


def strip_accents(text: Column) -> Column:
    """Lower case, decomposed, without combining marks."""
    import unicodedata

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)) for t in part], dtype="object")

    return run(text)


def framed(tokens: Column) -> Column:
    """[CLS] tokens [SEP]"""
    return F.concat(F.array(F.lit("[CLS]")), tokens, F.array(F.lit("[SEP]")))
