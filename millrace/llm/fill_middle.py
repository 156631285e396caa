"""Fill-in-the-middle: a text is cut at two of its unit boundaries into prefix, middle and suffix, whose order is then changed.

Boundaries come from big integers, one bit a byte of the text: `bytes.translate` turns the text into the mask of a class
of bytes, shifted Boolean operations of masks mark the bytes that units start at, `bit_count` says how many units there
are, and the start of the unit of a given rank is found by recursive halving: the lower half's count tells which half
holds it. Every step is linear in the text, and the masks take an eighth of it. In UTF-8 no byte of a longer character
looks like an ASCII one, so the units of bytes are those of code points.

Units are lines with their line feed, or words (a run of characters other than white space) with the white space after
them; white space at the very start is a unit too. Where to cut and which form to write follows from the SHA-256 digest
of "seed:doc_id": four 32-bit numbers h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
units, the middle after the larger. h3 % 100 decides whether the text is changed at all, h4 % 100 on the form.

Forms: psm `<P>`prefix`<S>`suffix`<M>`middle; spm `<S>`suffix`<P>`prefix`<M>`middle; plain, the text as it is: for empty
texts and for those that already hold a mark, since they could not be told apart again. `restored` is the way back.

Rows are handled one by one; nothing is shuffled but small tables that are dealt to all cores.

Defined cases: null text is empty; a null doc_id counts as an empty one; texts of any length are cut whole; repeated
rows get the same result each; an empty table gives no row; other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _class(of: bytes) -> bytes:
    """The table that translates the bytes of a class to the digit 1 and all others to 0."""
    return bytes(b"1"[0] if k in of else b"0"[0] for k in range(256))


#: Bytes that end a line, and that part words.
CLASSES = {"line": _class(b"\n"), "word": _class(b" \t\n\v\f\r")}
#: Continuation bytes of UTF-8; every other byte starts a character.
INNER = _class(bytes(range(0x80, 0xC0)))


@dataclass(frozen=True)
class Plan:
    """What to do: marks, the seed, the share of texts (in 100) that are changed and of these that become spm, the unit."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "7"
    rate: int = 100
    spm: int = 50
    unit: str = "line"


LINES = Plan()


def class_mask(data: bytes, of: bytes) -> int:
    """Bit i is set if byte i is one of the class."""
    return int(data[::-1].translate(of), 2) if data else 0


def starts(data: bytes, unit: str = "line") -> int:
    """Bit i is set if a unit starts at byte i."""
    if not data:
        return 0
    whole = (1 << len(data)) - 1
    ends = class_mask(data, CLASSES[unit])
    if unit == "word":  # a word starts where white space stops
        return (((ends << 1) & ~ends) | 1) & whole
    return ((ends << 1) | 1) & whole


def ranked(mask: int, rank: int) -> int:
    """The place of the set bit that `rank` others stand below."""
    at, width = 0, mask.bit_length()
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, at, width = mask >> half, rank - below, at + half, width - half
    return at


def cut(data: bytes, h1: int, h2: int, unit: str = "line") -> tuple[int, int, int]:
    """(n units, bytes before the middle, bytes before the suffix)."""
    mask = starts(data, unit)
    n = mask.bit_count()
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ranked(mask, low) if low < n else len(data), ranked(mask, high) if high < n else len(data)


def characters(data: bytes, *places: int) -> list[int]:
    """The characters before each place."""
    inner = class_mask(data, INNER)
    return [p - (inner & ((1 << p) - 1)).bit_count() for p in places]


def transformed(data: bytes, h: tuple[int, int, int, int], plan: Plan = LINES) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text in UTF-8."""
    p, s, m = plan.prefix.encode(), plan.suffix.encode(), plan.middle.encode()
    n, a, b = cut(data, h[0], h[1], plan.unit)
    if not data or p in data or s in data or m in data or h[2] % 100 >= plan.rate:
        return n, "plain", None, None, data
    before, until = characters(data, a, b)
    if h[3] % 100 < plan.spm:
        return n, "spm", before, until - before, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", before, until - before, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def restored_text(output: bytes, form: str, plan: Plan = LINES) -> bytes:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    p, s, m = plan.prefix.encode(), plan.suffix.encode(), plan.middle.encode()
    head, _, middle = output.partition(m)
    if form == "spm":
        suffix, _, prefix = head[len(s) :].partition(p)
    else:
        prefix, _, suffix = head[len(p) :].partition(s)
    return prefix + middle + suffix


OUT = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.BinaryType()),
    ]
)


def _numbers(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, plan: Plan = LINES) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output (a string)."""

    @F.pandas_udf(OUT)
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, *h in parts:
            rows = [transformed(bytes(t), k, plan) for t, k in zip(text, zip(*(x.tolist() for x in h), strict=True), strict=True)]
            out = pd.DataFrame(rows, columns=OUT.names)
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            yield out

    text = F.coalesce("text", F.lit("")).cast("binary")
    made = docs.select("doc_id", run(text, *_numbers(F.col("doc_id"), plan.seed)).alias("r"))
    return made.select("doc_id", "r.n", "r.form", "r.prefix_chars", "r.middle_chars", F.col("r.output").cast("string").alias("output"))


def restored(output: Column, form: Column, plan: Plan = LINES) -> Column:
    """The text again, from output and form alone."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in parts:
            yield pd.Series([restored_text(bytes(o), f, plan) for o, f in zip(outputs, forms, strict=True)], dtype="object")

    return run(output.cast("binary"), form).cast("string")


def digests(made: DataFrame, plan: Plan = LINES) -> DataFrame:
    """What fill_in_middle made, with digests in place of texts; restored_sha256 is of the text rebuilt from the output."""
    back = made.withColumn("restored", restored(F.col("output"), F.col("form"), plan))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
