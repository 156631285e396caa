"""Conversions that are sequential within a text, in Arrow batches: phrases by longest match, bytes of unknown encodings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_trie(table: dict[str, str]) -> dict:
    """Nested maps from character to character; under "" stands what a phrase becomes."""
    top: dict = {}
    for phrase, out in table.items():
        at = top
        for c in phrase:
            at = at.setdefault(c, {})
        if phrase:
            at[""] = out
    return top


def converted(text: str, trie: dict, heads: re.Pattern) -> str:
    """text with the longest phrase at each place converted, from the left; what is converted is not looked at again."""
    out, at = [], 0
    while (m := heads.search(text, at)) is not None:
        k = m.start()
        out.append(text[at:k])
        here, end, found = trie, k, None
        while end < len(text) and (here := here.get(text[end])) is not None:
            end += 1
            if "" in here:
                found, at = here[""], end
        if found is None:
            out.append(text[k])
            at = k + 1
        else:
            out.append(found)
    return "".join([*out, text[at:]])


def convert_phrases(text: Column, table: dict[str, str]) -> Column:
    """Conversion by phrases of any length and single characters: at each place the longest entry of the table holds.

    Phrases come before the characters they are made of (a phrase may convert its characters unlike the characters alone).
    The caller supplies the table. Null stays null.
    """
    trie = phrase_trie(table)
    if not trie:
        return text
    heads = re.compile("[" + "".join(map(re.escape, trie)) + "]")

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else converted(t, trie, heads) for t in part], dtype="object")

    return run(text)


#: Encodings that a line of bytes may be in. UTF-8 that is valid is never questioned.
ENCODINGS = ("utf-8", "gb18030", "cp1252")
#: What tells the others apart: pairs of the first level of Chinese characters, and single bytes of the upper half.
_COMMON_PAIR = re.compile(rb"[\xB0-\xD7][\xA1-\xFE]|[\xA1-\xA3][\xA1-\xFE]")
_PAIR = re.compile(rb"[\x81-\xFE][\x40-\x7E\x80-\xFE]|[\x81-\xFE][0-9][\x81-\xFE][0-9]")
_UPPER = re.compile(rb"[\x80-\xFF]")
#: A rare pair whose second byte is a letter that another follows: it may as well end in an accented word.
_IN_WORD = re.compile(rb"[\xC0-\xFE][A-Za-z]{2}")


def encoding_cost(line: bytes, encoding: str) -> float:
    """How unlikely a line of bytes is in an encoding: 10 for an invalid place, less for what is valid but rare.

    gb18030: nothing for a frequent character or mark, 1.5 for a rare one, 1.2 for one that stands alone. cp1252: 0.3 for an accented letter, 0.6 for a
    mark, 2 for a byte that few texts have, and 0.5 for every two that stand together. utf-8: the invalid places.
    """
    if encoding == "utf-8":
        return 10.0 * line.decode("utf-8", "replace").count("\ufffd")
    if encoding == "gb18030":
        cost, at, run = 0.0, 0, 0
        while (m := _UPPER.search(line, at)) is not None:
            if m.start() > at:
                cost, run = cost + 1.2 * (run == 1), 0
            p = _PAIR.match(line, m.start())
            if p is None:
                cost, at, run = cost + 10, m.start() + 1, 0
                continue
            cost, at, run = cost + 1.5 * (not _COMMON_PAIR.fullmatch(p[0])), p.end(), run + 1
        return cost + 1.2 * (run == 1)
    cost, last = 0.0, -2
    for m in _UPPER.finditer(line):
        b, k = line[m.start()], m.start()
        cost += (0.3 if b >= 0xC0 and b not in (0xD7, 0xF7) else 0.6 if b >= 0xA0 else 10 if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else 2) + 0.5 * (k == last + 1)
        last = k
    return cost


def in_words(line: bytes) -> int:
    """How many pairs of gb18030 look like an accented letter within a word."""
    at = found = 0
    while (m := _UPPER.search(line, at)) is not None:
        p = _PAIR.match(line, m.start())
        found += p is not None and _IN_WORD.match(line, m.start()) is not None
        at = p.end() if p is not None else m.end()
    return found


#: Accented letters of western languages: a word has those of one of them.
_ALPHABETS = tuple(frozenset(x + x.replace("ß", "").replace("ÿ", "").upper()) for x in ("àâæçèéêëîïôùûüÿœ", "áéíñóúü", "äöüß", "àáâãçéêíóôõú", "åäæéöø"))
_LETTERS = re.compile(rb"[A-Za-z\x80-\xFF]+")


def spelt(line: bytes) -> bool:
    """Whether all words of cp1252 with accented letters have them of one language, in capitals, in small letters or with a first capital.

    Pairs of gb18030 seldom look so: half of their bytes are marks or letters that these languages lack, and the cases mix.
    """
    words = [w[0].decode("cp1252", "replace") for w in _LETTERS.finditer(line) if _UPPER.search(w[0])]
    if not all(w.islower() or w.isupper() or (w[0].isupper() and w[1:].islower()) for w in words):
        return False
    accented = {c for w in words for c in w if c > "\x7f"}
    return bool(accented) and any(accented <= letters for letters in _ALPHABETS)


def decoded_line(line: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """A line of bytes in the encoding of the least cost (ties: the first); invalid bytes become U+FFFD.

    A pair of gb18030 that looks like an accented letter within a word costs 1 more here. A line of words that are
    spelt as in one western language is cp1252, also where its accented letters make pairs.
    """
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        if "cp1252" in encodings and spelt(line):
            return line.decode("cp1252")
        best = min(encodings, key=lambda e: (encoding_cost(line, e) + (in_words(line) if e == "gb18030" else 0), encodings.index(e)))
        return line.decode(best, "replace")


def decode_mixed(raw: Column, encodings: tuple[str, ...] = ENCODINGS) -> Column:
    """Bytes as text, line by line, since files are pasted together of several encodings; null stays null.

    Each line is read in the encoding that its bytes speak for most. No character of these encodings holds a line feed byte.
    """

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "\n".join(decoded_line(x, encodings) for x in bytes(t).split(b"\n")) for t in part], dtype="object")

    return run(raw)
