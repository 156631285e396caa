"""METEOR with stems, over the alignment of the fewest chunks."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alignments that are kept at once while a candidate is read. The result is exact while there are no more.
BEAM = 32

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")
_MEASURE = re.compile(r"(?:[aeiou]|(?<=[^aeiou])y)+[^aeiouy]")


def stem(word: str) -> str:
    """Plurals, -ed, -ing and a final y, by the rules of step 1 of Porter's algorithm (1980); words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _MEASURE.search(word[:-3]):
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _VOWEL.search(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif re.fullmatch(r"[^aeiou]*[aeiouy][^aeiouwxy]", word) and len(_MEASURE.findall(word)) == 1:
                    word += "e"
                break
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    return word


def aligned(candidate: list[str], reference: list[str], beam: int = BEAM) -> tuple[int, int]:
    """(matches, chunks) of the best alignment: most equal words, then most equal stems, then the fewest chunks.

    A chunk is a run of matches that are neighbours on both sides. The candidate is read word by word; kept are states of
    what is used of the reference and where the last word went, those with most matches and fewest chunks first.
    """
    words: dict[str, list[int]] = {}
    stems: dict[str, list[int]] = {}
    rs = [stem(w) for w in reference]
    for j, w in enumerate(reference):
        words.setdefault(w, []).append(j)
        stems.setdefault(rs[j], []).append(j)
    # how many matches there are of each kind does not depend on the places
    left_c, left_r = Counter(candidate), Counter(reference)
    exact = left_c & left_r
    want = sum(exact.values()), sum((_by_stem(left_c - exact) & _by_stem(left_r - exact)).values())
    states: dict[tuple[int, int, int, int], int] = {(-2, 0, 0, 0): 0}  # (last place, used, equal words, equal stems): chunks
    for w in candidate:
        new: dict[tuple[int, int, int, int], int] = {}
        same, near = words.get(w, ()), stems.get(stem(w), ())
        for (last, used, a, b), chunks in states.items():
            steps = [((-2, used, a, b), chunks)]
            for j in near:
                if not used >> j & 1:
                    equal = reference[j] == w
                    steps.append(((j, used | 1 << j, a + equal, b + (not equal)), chunks + (j != last + 1)))
            for key, n in steps:
                if key[2] <= want[0] and key[3] <= want[1] and n < new.get(key, 1 << 30):
                    new[key] = n
        if len(new) > beam and (same or near):
            new = dict(sorted(new.items(), key=lambda x: (-(x[0][2] + x[0][3]), x[1], x[0]))[:beam])
        states = new
    best = min(states.items(), key=lambda x: (-x[0][2], -x[0][3], x[1]))
    return best[0][2] + best[0][3], best[1]


def _by_stem(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        out[stem(w)] += n
    return out


def meteor_of(candidate: str | None, reference: str | None, beam: int = BEAM) -> float:
    cs, rs = (candidate or "").lower().split(), (reference or "").lower().split()
    hits, chunks = aligned(cs, rs, beam)
    if not hits:
        return 0.0
    p, q = hits / len(cs), hits / len(rs)
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / hits) ** 3)


def meteor(candidate: Column, reference: Column, beam: int = BEAM) -> Column:
    """METEOR of two texts by equal words, then equal stems (no synonyms): recall weighted 9 to 1, less for each chunk."""

    @F.pandas_udf("double")
    def run(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([meteor_of(a, b, beam) for a, b in zip(c, r, strict=True)], dtype="float64")

    return run(candidate, reference)
