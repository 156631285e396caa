"""What the operators of this subpackage share: size-checked broadcasts, column names, word columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import discard, shared_dir, stored  # noqa: F401

#: Rows of (at most a few longs each) up to which a side is broadcast; a larger side is shuffled instead.
BROADCAST_ROWS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to differ from every column of df."""
    while name in df.columns:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are within the limit; else Spark's own choice."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast built-in; other text must not be case-folded beyond A-Z."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, ASCII digits and non-ASCII characters; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
