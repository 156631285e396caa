"""Seams for models: callables with deterministic defaults that need no weights.

embed(text) -> vector, ner(text) -> names, generate(prompt) -> text. Any callable of the same form may take their place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalise

DIM = 64
WORD = re.compile(r"\w+")


#: Places of words that were met, as long as they are few.
_PLACES: dict[str, int] = {}
MAX_PLACES = 50_000


def embed(text: str, dim: int = DIM) -> np.ndarray:
    """A bag of words hashed to dim places (first 32 bits of md5), of unit length; zero for text without words."""
    if len(_PLACES) > MAX_PLACES:
        _PLACES.clear()
    at = []
    for w in WORD.findall(text.lower()):
        k = _PLACES.get(w)
        if k is None:
            k = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            if len(w) <= 32:
                _PLACES[w] = k
        at.append(k % dim)
    v = np.bincount(at, minlength=dim).astype(float) if at else np.zeros(dim)
    n = np.linalg.norm(v)
    return v / n if n else v


def word_place(word: Column, dim: int = DIM) -> Column:
    """The place of a word in the hashed bag, as in `embed`."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def embeddings(texts: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(key, place, value) of every non-zero place of the hashed bag of words, by aggregation: no Python.

    Words are split at anything but letters, digits and underscores.
    """
    words = F.array_remove(F.split(normalise(F.col(text)), r"[^\p{L}\p{N}_]+"), "")
    counts = texts.select(key, F.explode(words).alias("w")).groupBy(key, word_place(F.col("w"), dim).alias("place")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "place", (F.col("n") / F.col("norm")).alias("value"))


def names(text: Column) -> Column:
    """Capitalised words of 2 to 9 characters, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}\p{L}{1,8})\b"), F.lit(1)))


def word_class(word: Column) -> Column:
    """A noun (n), verb (v) or adjective (a) by the word's ending, x for words of one or two letters."""
    return F.when(F.length(word) < 3, "x").when(word.rlike("(?:ing|ed|ize|ate)$"), "v").when(word.rlike("(?:ous|ful|ive|al)$"), "a").otherwise("n")


def corrected(text: Column, model: Callable[[str], str]) -> Column:
    """A corrector's answer to every text that is not null."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else model(t))

    return run(text)


def metadata_relevance(content: Column, items: Column, model: Callable[[str], np.ndarray] = embed) -> Column:
    """The cosine of a content's vector and that of "key: value", for each item of an array of (key, value)."""

    @F.pandas_udf("array<double>")
    def run(contents: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([relevances(t or "", [(i["key"], i["value"]) for i in found], model) for t, found in zip(contents, lists, strict=True)])

    return run(content, items)


def relevances(content: str | np.ndarray, items: list[tuple[str, str]], model: Callable[[str], np.ndarray] = embed, known: dict[tuple[str, str], np.ndarray] | None = None) -> list[float]:
    """content: a text or its vector. known: vectors of items, kept from one call to the next by who gives it."""
    known = {} if known is None else known

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        size = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / size if size else 0.0

    own = np.asarray(model(content) if isinstance(content, str) else content, float)
    for k, v in items:
        if (k, v) not in known:
            known[k, v] = np.asarray(model(f"{k}: {v}"), float)
    return [cosine(own, known[k, v]) for k, v in items]


def echo(prompt: str) -> str:
    return prompt
