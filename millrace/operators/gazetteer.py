"""Names of a table found in texts: every place where the words of a name stand one after the other.

Each word of a text meets the names that begin with it, and what follows is compared with the rest of the name, so one
pass over the words serves all names. The table of names is broadcast while its counted rows are few, else both sides
are shuffled by first word; it never has to fit into the memory of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that are broadcast at most.
BROADCAST_NAMES = 200_000
#: First words that so many names begin with are looked up together with the word that follows.
MANY = 50


def name_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def named(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", longest: bool = True) -> DataFrame:
    """(key, name, kind, at, words): the places of names (name, kind) in texts, `at` counts words from 0.

    longest: of places that overlap in the sense that one lies within the other, the longest holds; names of equal words
    are all reported. Names without words are in no text.
    """
    known = names.select("name", "kind", name_words(F.col("name")).alias("ws")).where(F.size("ws") > 0).distinct()
    n, most = known.agg(F.count("*"), F.coalesce(F.max(F.size("ws")), F.lit(1))).first()
    # frequent first words are told apart by the second
    hot = known.groupBy(F.get("ws", F.lit(0)).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(F.col("w").alias("hw"))
    known = known.join(hot, F.get("ws", F.lit(0)) == F.col("hw"), "left")
    two = F.col("hw").isNotNull() & (F.size("ws") > 1)
    first = F.when(two, F.array_join(F.slice("ws", 1, 2), " ")).otherwise(F.get("ws", F.lit(0)))
    known = known.select("name", "kind", F.col("ws").alias("nws"), first.alias("first"))
    if n <= BROADCAST_NAMES:
        known = F.broadcast(known)
    each = docs.select(F.col(key), name_words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    ahead = F.transform("ws", lambda w, i: F.slice(F.col("ws"), i + 1, F.lit(most)))
    places = each.select(key, F.posexplode(ahead).alias("at", "next"))
    # a word is looked up alone and with the next one: a name is stored under one of the two
    looked = F.array_distinct(F.array(F.get("next", F.lit(0)), F.array_join(F.slice("next", 1, 2), " ")))
    met = places.select(key, "at", "next", F.explode(looked).alias("f")).join(known, F.col("f") == F.col("first"))
    found = met.where(F.slice("next", F.lit(1), F.size("nws")) == F.col("nws")).select(key, "name", "kind", "at", F.size("nws").alias("words"))
    if not longest:
        return found
    # a place lies within another if one that starts no later ends no earlier and is longer
    w = Window.partitionBy(key).orderBy("at", F.desc("words"))
    reach = F.max(F.struct((F.col("at") + F.col("words")).alias("e"), F.col("words"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = found.withColumn("r", reach)
    inside = (F.col("r.e") >= F.col("at") + F.col("words")) & (F.col("r.words") > F.col("words"))
    return own.where(~inside).select(key, "name", "kind", "at", "words")
