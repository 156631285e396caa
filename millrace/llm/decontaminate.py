"""Benchmark decontamination: a hash set of normalised test n-grams, a scan of training token windows, and a check of every hit.

Built-in DataFrame functions only. A window is `width` consecutive words of a benchmark item (an item of fewer words
is one window). Any run of L words covers a whole block of (L + 1) // 2 words that starts at a multiple of that
length, so a document is scanned block by block, not word by word: the blocks are looked up in the hash set of the
windows' sub-blocks, the few starts around a match are looked up in the hash set of whole windows, and every hit is
compared word for word with its window before it counts.

Defined cases: null or empty text has no words and no hits; an item without words has no window; a row of an empty
benchmark leaves every document clean; rows that repeat (doc_id, text) are scanned and counted together, reported
each, and kept or removed together; a null doc_id is a key like any other; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import alnum_words, broadcast_if_small, unused

WIDTH = 13
#: Hashes up to which the set is part of the scan expression; a larger set is joined.
INLINE_HASHES = 200_000
#: Copies of a row that one array stands for.
COPIES = 10_000


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(l, h, w, items): each distinct window, its length, hash and words, and the ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("ws"))
    items = items.where(F.size("ws") > 0).withColumn("l", F.least(F.lit(width), F.size("ws")))
    each = items.select("item", "l", F.explode(F.expr("transform(sequence(0, size(ws) - l), i -> slice(ws, i + 1, l))")).alias("w"))
    return each.groupBy("l", "w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("w"))


def _in(values: list[int]) -> str:
    return f"IN ({', '.join(map(str, values))})" if values else "IN (null)"


def _starts(words: DataFrame, windows: DataFrame, inline: int) -> DataFrame:
    """words (ws, ...) with `hits`: array of (p, l, h) where the window of length l that starts at word p has a known hash."""
    lengths = sorted(r["l"] for r in windows.select("l").distinct().collect())  # at most `width` numbers
    total = windows.count()
    if not lengths:
        return words.withColumn("hits", F.expr("cast(array() as array<struct<p:bigint,l:int,h:bigint>>)"))
    parts = []
    for l in lengths:
        b = (l + 1) // 2
        blocks = windows.where(F.col("l") == l).select(F.explode(F.expr(f"transform(sequence(0, {l - b}), i -> xxhash64(slice(w, i + 1, {b})))")).alias("b")).distinct()
        if total * (l - b + 1) <= inline:
            whole = _in([r[0] for r in windows.where(F.col("l") == l).select("h").collect()])
            known = _in([r[0] for r in blocks.collect()])
        else:
            known = whole = ""
        parts.append((l, b, blocks, known, whole))
    named = []
    for l, b, blocks, known, whole in parts:
        found, hits = f"__found{l}", f"__hits{l}"
        if known:
            words = words.withColumn(found, F.expr(f"filter(if(size(ws) >= {l}, sequence(0L, size(ws) div {b} - 1), cast(array() as array<bigint>)), j -> xxhash64(slice(ws, int(j * {b} + 1), {b})) {known})"))
        else:
            words = _joined(words, blocks, l, b, found)
        # the starts whose window covers a block that begins at word j * b: from j * b - (l - b) to j * b
        starts = f"array_distinct(flatten(transform({found}, j -> sequence(greatest(0L, j * {b} - {l - b}), greatest(0L, least(j * {b}, size(ws) - {l}))))))"
        test = f"filter({starts}, p -> xxhash64(slice(ws, int(p + 1), {l})) {whole})" if whole else starts
        words = words.withColumn(hits, F.expr(f"if(size({found}) = 0, cast(array() as array<struct<p:bigint,l:int,h:bigint>>), transform({test}, p -> named_struct('p', p, 'l', {l}, 'h', xxhash64(slice(ws, int(p + 1), {l})))))")).drop(found)
        named.append(hits)
    return words.withColumn("hits", F.concat(*named)).drop(*named)


def _joined(words: DataFrame, blocks: DataFrame, l: int, b: int, found: str) -> DataFrame:
    """The block look-up for a set too large for the expression: the blocks are exploded and joined, then gathered by document."""
    keyed = words.withColumn("__row", F.struct("k_id", "k_text"))
    each = keyed.where(F.size("ws") >= l).select("__row", F.posexplode(F.expr(f"transform(sequence(0L, size(ws) div {b} - 1), j -> xxhash64(slice(ws, int(j * {b} + 1), {b})))")).alias("j", "b"))
    got = each.join(broadcast_if_small(blocks, blocks.count()), "b", "left_semi").groupBy("__row").agg(F.array_sort(F.collect_set("j")).alias(found))
    out = keyed.join(got, keyed["__row"].eqNullSafe(got["__row"]), "left").drop("__row")
    return out.withColumn(found, F.coalesce(F.col(found), F.expr("cast(array() as array<bigint>)")))


def _covered(spans: Column) -> Column:
    """How many words the spans (p, l) cover together."""
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, s: F.struct(
        F.coalesce(a["n"] + F.greatest(F.lit(0), s["p"] + s["l"] - F.greatest(a["end"], s["p"])), F.lit(0).cast("bigint")).alias("n"),
        F.coalesce(F.greatest(a["end"], s["p"] + s["l"]), F.lit(0).cast("bigint")).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), first, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, inline: int = INLINE_HASHES) -> DataFrame:
    """One row per distinct (doc_id, text): k_id, k_text (hash of the text), copies, n_words, n_hit, spans, items.

    spans: array of (p, l), the verified windows; items: sorted ids, as strings, of the items that have one.
    """
    windows = windows_of(benchmark, width)
    base = docs.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), alnum_words(F.col("text")).alias("ws"))
    scanned = _starts(base, windows, inline)
    each = scanned.select("k_id", "k_text", F.size("ws").cast("bigint").alias("n_words"), F.posexplode_outer(F.expr("transform(hits, x -> named_struct('p', x.p, 'l', x.l, 'h', x.h, 'w', slice(ws, int(x.p + 1), x.l)))")).alias("at", "x"))
    known = broadcast_if_small(windows.select(F.col("l").alias("wl"), F.col("h").alias("wh"), F.col("w").alias("ww"), "items"), windows.count())
    met = each.join(known, (F.col("x.h") == F.col("wh")) & (F.col("x.l") == F.col("wl")) & (F.col("x.w") == F.col("ww")), "left")
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("x.p").alias("p"), F.col("x.l").alias("l")))
    grouped = met.groupBy("k_id", "k_text").agg(F.count_if(F.coalesce(F.col("at"), F.lit(0)) == 0).alias("copies"), F.max("n_words").alias("n_words"), F.collect_set(hit).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.withColumn("n_hit", _covered(F.col("spans")))


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one hit word, and hit words make up 1/share of the words or more."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, unit: str = "documents", width: int = WIDTH, share: int = 20) -> DataFrame:
    """docs without contaminated documents, or (unit="spans") with the hit words cut out of the texts."""
    report = contamination(docs, benchmark, width).where(F.col("n_hit") > 0)
    i, h, found = unused(docs, "bad_id"), unused(docs, "bad_text"), unused(docs, "spans")
    if unit == "documents":
        report = report.where(contaminated(F.col("n_hit"), F.col("n_words"), share))
    bad = report.select(F.col("k_id").alias(i), F.col("k_text").alias(h), F.col("spans").alias(found))
    same = docs["doc_id"].eqNullSafe(bad[i]) & F.xxhash64(docs["text"]).eqNullSafe(bad[h])
    if unit == "documents":
        return docs.join(bad, same, "left_anti")
    if unit != "spans":
        raise ValueError("unit is documents or spans")
    marked = docs.join(bad, same, "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps = F.split(F.col("text"), word)
    words = F.regexp_extract_all(F.col("text"), F.lit(word), F.lit(0))
    in_span = lambda i: F.exists(found, lambda s: (s["p"] <= i) & (i < s["p"] + s["l"]))
    pieces = F.transform(words, lambda w, i: F.when(in_span(i), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))
    return marked.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cut)).select(docs.columns)


def report_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract from `contamination`, a row for every row of docs."""
    r = contamination(docs, benchmark)
    # copies are dealt in two steps, so that no array grows with them
    r = r.withColumn("from", F.explode(F.expr(f"sequence(1L, copies, {COPIES}L)"))).withColumn("copy", F.explode(F.expr(f"sequence(`from`, least(copies, `from` + {COPIES - 1}L))")))
    return r.select(
        F.col("k_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
