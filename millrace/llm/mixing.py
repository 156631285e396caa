"""Mixing sources to target weights: how many words of every document a mix takes, each source to its exact budget.

Sizes are words. A source's target is its share by weight of what the mix holds, but no more than `most` times its own
size; what is above goes to the other sources by weight, until none is above. Each source's documents stand in the order
of a hash of seed and doc_id, range-sorted with the source first, so that a source with a third of all documents is
spread over a third of the partitions. Sums of sizes by partition and source give every partition the words before it;
only where a budget ends within a partition are the documents of that source there summed one by one. That gives a cut a
source: every document before it is taken once more than the whole epochs that the budget holds, the document at the cut
for the words that are missing, and those behind it for the whole epochs alone. Texts are never sorted or shuffled: the
cuts, a row a source, are joined to the documents.

`plan` returns the words taken of each document, `mixed` the texts themselves, a row for each epoch of a document.

Defined cases: null and empty texts and those of white space have size 0 and nothing is taken of them; documents without
source form one source, the last one; rows with the same doc_id, source and size stand together and the same number of
words is taken of each of them, so a cut among m such rows may leave up to m - 1 words of the budget; a null doc_id is
hashed as an empty one; a source without words has the target 0; texts count whole; an empty table gives no row; other
columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, discard, stored, unused

SPACE, WORD = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)


def size_of(text: Column) -> Column:
    """The words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, key), key: hash-random by document. Written to the shared folder: texts are read once."""
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    return stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key")), "mix-sized")


def _before(part: str = "part") -> Window:
    return Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)


def weighted(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """sources with `weight`: the cycle's weights dealt in the sources' order by code point, null last."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    offsets = parts.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(_before()), F.lit(0)).alias("offset"))  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    number = parts.withColumn("own", own).join(F.broadcast(offsets), "part").withColumn("number", F.col("own") + F.col("offset") - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("number") % len(cycle) + 1).cast("int"))
    out = stored(number.select(*sources.columns, weight.cast("long").alias("weight")), "mix-weights")
    discard(parts)
    return out


def targets(sources: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size, weight) with `target`: shares by weight of share times all sizes, none above most times its size.

    Every turn reads one row of sums; a source that is at its limit stays there, so the turns end.
    """
    cap, all_of = F.col("source_size") * most, F.sum("source_size")
    first = sources.agg(all_of.alias("size"), F.sum("weight").alias("w")).first()
    rest, w, level, full = share * float(first["size"] or 0), float(first["w"] or 0), None, 0
    total = rest
    while w:
        level = rest / w
        over = F.lit(level) * F.col("weight") > cap
        now = sources.agg(F.count_if(over).alias("full"), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("w")).first()
        if now["full"] == full:
            break
        full, rest, w = now["full"], total - float(now["held"]), float(now["w"])
    if not w:  # all are at their limits
        return sources.withColumn("target", cap.cast("double"))
    share_of = F.least(cap.cast("double"), F.lit(rest) * F.col("weight") / F.lit(w))
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > cap, cap.cast("double")).otherwise(share_of))


def cuts(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut, each): the unit (key, doc_id, size) in which a source's last epoch ends, and the words taken there of each row.

    budgets: (source, rest), rest: the words of the last epoch, fewer than the source has. Sources with rest 0 have no cut.
    """
    units = sized.where("size > 0").groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("m"))
    order = [F.col("source").asc_nulls_last(), "key", "doc_id", "size"]
    parts = stored(units.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    sums = parts.groupBy("source", "part").agg(F.sum(F.col("m") * F.col("size")).alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = budgets.where("rest > 0").withColumnRenamed("source", "s2")
    inside = (F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("words"))
    ends = sums.withColumn("ahead", ahead).join(wanted, F.col("source").eqNullSafe(F.col("s2"))).where(inside).select("s2", F.col("part").alias("p2"), "ahead", "rest")  # a row a source
    ends = stored(ends, "mix-ends")
    near = parts.join(broadcast_if_small(ends, ends.count()), (F.col("part") == F.col("p2")) & F.col("source").eqNullSafe(F.col("s2")))
    own = F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until = near.withColumn("until", own + F.col("ahead")).where("until > rest and until - m * size <= rest")
    each = F.floor((F.col("rest") - (F.col("until") - F.col("m") * F.col("size"))) / F.col("m")).cast("long")
    out = stored(until.select("source", F.struct("key", "doc_id", "size").alias("cut"), each.alias("each")), "mix-cuts")
    discard(parts, ends)
    return out


def budgeted(sized: DataFrame, weights: DataFrame | tuple[int, ...] = CYCLE, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, epochs, cut, each), a row a source. weights: a cycle, or a table (source, weight)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, tuple):
        known = weighted(sources, weights)
    else:
        given = weights.select(F.col("source").alias("s2"), F.col("weight").cast("long").alias("weight"))
        known = stored(sources.join(given, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0).cast("long")).alias("weight")), "mix-weights")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rows = targets(known, share, most).withColumn("budget", budget)
    some = F.col("source_size") > 0
    rows = rows.withColumn("epochs", F.when(some, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    rows = stored(rows.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    cut = cuts(sized, rows.select("source", "rest")).withColumnRenamed("source", "s2")
    out = stored(rows.join(cut, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "source_size", "target", "epochs", "cut", "each"), "mix-budgets")
    discard(known, rows)
    return out


def _taken(key: Column, doc_id: Column, size: Column) -> Column:
    """The words taken of a document, from its source's row of `budgeted`."""
    own = F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size"))
    last = F.when(F.col("cut").isNull() | (size == 0), 0).when(own < F.col("cut"), size).when(own == F.col("cut"), F.col("each")).otherwise(0)
    return size * F.col("epochs") + last


def plan(docs: DataFrame, weights: DataFrame | tuple[int, ...] = CYCLE, share: float = 1.5, most: int = 2, seed: str = "13") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken."""
    sized = _sized(docs, seed)
    known = budgeted(sized, weights, share, most).withColumnRenamed("source", "s2")
    both = sized.join(broadcast_if_small(known, known.count()), F.col("source").eqNullSafe(F.col("s2")))
    return both.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("key"), F.col("doc_id"), F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame | tuple[int, ...] = CYCLE, share: float = 1.5, most: int = 2, seed: str = "13") -> DataFrame:
    """The mix itself: the columns of docs, a row for each epoch that takes words of a document, with `epoch` (from 1).

    Texts at a cut end with the last word that is taken. The texts are not shuffled where the sources' rows can be broadcast.
    """
    sized = _sized(docs, seed)
    known = budgeted(sized, weights, share, most).withColumnRenamed("source", unused(docs, "s2"))
    discard(sized)
    s2, own, epoch = known.columns[0], F.struct(*docs.columns).alias("own"), unused(docs, "epoch")
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("own.doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    rows = docs.select(own, size_of(F.col("text")).alias("size")).where("size > 0")
    rows = rows.join(broadcast_if_small(known, known.count()), F.col("own.source").eqNullSafe(F.col(s2)))
    rows = rows.withColumn("taken", _taken(key, F.col("own.doc_id"), F.col("size"))).where("taken > 0")
    rows = rows.select("own", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("epoch"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    text = F.when(words == F.col("size"), F.col("own.text")).otherwise(first_words(F.col("own.text"), words))
    return rows.select(*[text.alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns], F.col("epoch").alias(epoch))
