"""Vectors: similarity, exact and inverted-file search, a vector table with upsert, keywords, retrieval prompts."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators import blocks as B
from millrace.storage import discard, stored

#: Queries up to which one batch of them is sent to every task; more are searched batch by batch.
QUERY_BATCH = 2_000
#: Differences that are held at once.
BLOCK_VALUES = 2_000_000
#: Rows that are compared with the queries at once.
ROWS = 1_000
#: Parts of a vector table, by a hash of the document's id; an update rewrites the parts of its documents alone.
BUCKETS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 5, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): the k nearest rows of each query. Exact.

    A stated batch of queries is sent to the tasks, which keep k rows a query of what they read; only those are merged.
    """
    parts = [_batch(vectors, queries[a : a + QUERY_BATCH], k, metric, key, vector) for a in range(0, len(queries), QUERY_BATCH)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _batch(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, metric: str, key: str, vector: str) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    m = np.array([v for _, v in queries], float).reshape(len(queries), -1)
    if metric == "cosine":
        m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, m))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = sent.value
        best, own = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)  # scores and rows, best first
        for whole in parts:
            for at in range(0, len(whole), ROWS):
                part = whole.iloc[at : at + ROWS]
                x = np.stack(part["x"].to_numpy()).astype(float)
                v = part["v"].to_numpy(np.int64)
                if metric == "cosine":
                    x = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
                step = max(1, BLOCK_VALUES // (x.size if metric != "cosine" else len(x)))  # what is held at once: the same at every size
                for a in range(0, len(m), step):
                    q = m[a : a + step]
                    s = q @ x.T if metric == "cosine" else -np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
                    rows = np.flatnonzero((s >= best[a : a + step, -1:]).any(1))  # queries that a row here may be near to
                    if not len(rows):
                        continue
                    s = np.c_[best[a + rows], s[rows]]
                    vs = np.c_[own[a + rows], np.broadcast_to(v, (len(rows), len(v)))]
                    order = np.lexsort((vs, -s), axis=1)[:, :k]
                    best[a + rows], own[a + rows] = np.take_along_axis(s, order, 1), np.take_along_axis(vs, order, 1)
        q, r = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query": ids[q], "v": own[q, r], "score": best[q, r]})

    found = vectors.select(F.col(key).alias("v"), F.col(vector).alias("x")).mapInPandas(run, "query long, v long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "v")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("v").alias(key), "score", "rank")


def cell_index(vectors: DataFrame, cells: int = 100, key: str = "vec_id", vector: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """(centres, blocks): an index of all rows by cell, for exact search. The blocks are a table in the shared folder."""
    centres = B.centres_of(vectors, cells, key, vector)
    return centres, B.blocked(vectors, centres, key, vector)


def search_exact(index: tuple[np.ndarray, DataFrame], queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, distance, rank): the k nearest rows by L2 of every row of queries. Exact: see `operators.blocks`.

    The queries are a table like the rows; they are cut to blocks of near ones themselves and never pass the driver.
    """
    centres, rows = index
    if not len(centres):
        return rows.sparkSession.createDataFrame([], f"query long, {key} long, distance double, rank int")
    asked = B.blocked(queries, centres, key, vector)
    return B.nearest_rows(rows, asked, k).select("query", F.col("v").alias(key), "distance", "rank")


def inverted_file(vectors: DataFrame, cells: int = 100, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(centres, rows with `cell`). Centres come from a bounded sample (smallest hashes); every row gets its nearest cell."""
    some = vectors.orderBy(F.xxhash64(key)).limit(sample).select(vector).toPandas()[vector]
    x = np.stack(some.to_numpy()).astype(float)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        own = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])

    @F.pandas_udf("int")
    def cell(part: pd.Series) -> pd.Series:
        m = np.stack(part.to_numpy()).astype(float)
        return pd.Series(((c**2).sum(1)[None] - 2 * m @ c.T).argmin(1).astype("int32"))

    return c, vectors.withColumn("cell", cell(F.col(vector)))


def probe(index: tuple[np.ndarray, DataFrame], query: list[float], k: int = 5, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by L2 within the `probes` nearest cells: a filter on the cell, then TakeOrdered."""
    centres, rows = index
    near = np.argsort(((centres - np.asarray(query, float)) ** 2).sum(1))[:probes]
    q = F.lit([float(x) for x in query])
    return rows.where(F.col("cell").isin([int(x) for x in near])).select(key, l2(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def search(index: tuple[np.ndarray, DataFrame], queries: list[tuple[int, list[float]]], k: int = 5, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query by L2 within its `probes` nearest cells.

    Batches of queries are sent to the tasks as in `nearest`; a task compares a cell's rows only with the queries that probe it.
    """
    parts = [_search_batch(index, queries[a : a + QUERY_BATCH], k, probes, key, vector) for a in range(0, len(queries), QUERY_BATCH)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _search_batch(index: tuple[np.ndarray, DataFrame], queries: list[tuple[int, list[float]]], k: int, probes: int, key: str, vector: str) -> DataFrame:
    centres, rows = index
    ids = np.array([q for q, _ in queries], np.int64)
    m = np.array([v for _, v in queries], float).reshape(len(queries), -1)
    near = np.argsort((centres**2).sum(1)[None] - 2 * m @ centres.T, axis=1, kind="stable")[:, :probes]
    asks = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    sent = rows.sparkSession.sparkContext.broadcast((ids, m, asks))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m, asks = sent.value
        kept: pd.DataFrame | None = None
        for part in parts:
            got = [] if kept is None else [kept]
            for c, own in part.groupby("cell"):
                at = asks.get(int(c))
                if at is None:
                    continue
                x, v = np.stack(own["x"].to_numpy()).astype(float), own["v"].to_numpy()
                order = np.argsort(v, kind="stable")  # of equal distances the smallest ids
                x, v = x[order], v[order]
                for q in at:
                    d = np.sqrt(((x - m[q]) ** 2).sum(1))
                    best = np.argsort(d, kind="stable")[:k]
                    got.append(pd.DataFrame({"query": ids[q], "v": v[best], "distance": d[best]}))
            if got:
                kept = pd.concat(got).sort_values(["query", "distance", "v"]).groupby("query").head(k)
        if kept is not None:
            yield kept

    found = rows.select("cell", F.col(key).alias("v"), F.col(vector).alias("x")).mapInPandas(run, "query long, v long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "v")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", F.col("v").alias(key), "distance", "rank")


# -- vector table ------------------------------------------------------------------------------------------------------


def overridden(base: Column, custom: Column) -> Column:
    """A map with all entries of `custom`, and those of `base` whose keys are not among them."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(custom, e["key"])), F.map_entries(custom)))


def chunk_rows(chunks: DataFrame, metadata: Column | None = None) -> DataFrame:
    """Rows of the vector table out of (document_id, chunk_id, content, summary, keywords): the text that is embedded, the text that is stored.

    metadata: a map of the document's own; it wins over what is known of the chunk.
    """
    to_embed = F.concat_ws(" | ", "summary", F.array_join("keywords", " "), F.substring("content", 1, 200))
    rows = chunks.where(F.length("content") > 0)
    own = [F.to_json("keywords").alias("keywords")]
    if metadata is not None:
        known = {c: F.col(c).cast("string") for c in ("document_id", "chunk_id", "level", "parent_id", "timestamp") if c in chunks.columns} | {c: F.to_json(c) for c in ("keywords", "entities") if c in chunks.columns}
        own.append(overridden(F.create_map(*[x for c, v in known.items() for x in (F.lit(c), v)]), metadata).alias("metadata"))
    return rows.select("document_id", "chunk_id", to_embed.alias("embed_text"), F.substring("content", 1, 1000).alias("document"), *own)


def document_metadata(rows: DataFrame) -> DataFrame:
    """(document_id, metadata): the metadata of each document's first chunk."""
    return rows.groupBy("document_id").agg(F.min_by("metadata", "chunk_id").alias("metadata"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")


def _rewrite(spark: SparkSession, path: str, ids: DataFrame, new: DataFrame | None) -> None:
    """Replace the rows of some documents: their buckets are written anew aside, then moved into place.

    One rename makes the new buckets final. Whatever fails before it leaves the table as it was; whatever fails later is
    completed by `recover`, which every update calls first.
    """
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    recover(spark, path)
    if not fs.exists(of(path)):
        if new is not None:
            new.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(path)
        return
    touched = {r[0] for r in ids.select(_bucket()).distinct().collect()}  # BUCKETS numbers at most
    old = spark.read.parquet(path).where(F.col("bucket").isin(*touched)).join(ids.select("document_id").distinct(), "document_id", "left_anti")
    made = stored(old if new is None else old.unionByName(new.withColumn("bucket", _bucket()), allowMissingColumns=True), "vector-table")
    aside = f"{path}/_write-{uuid.uuid4().hex}"
    made.write.partitionBy("bucket").parquet(aside)
    for b in touched - {r[0] for r in made.select("bucket").distinct().collect()}:
        fs.mkdirs(of(f"{aside}/_gone/bucket={b}"))
    discard(made)
    fs.rename(of(aside), of(aside.replace("_write-", "_commit-")))
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Complete the updates of a vector table that were final but not yet in place; each step may be repeated."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(of(path)):
        return
    for commit in [x.getPath() for x in fs.listStatus(of(path)) if x.getPath().getName().startswith("_commit-")]:
        for new in [x.getPath() for x in fs.listStatus(commit) if x.getPath().getName().startswith("bucket=")]:
            _moved(fs, new, of(f"{path}/{new.getName()}"))
        gone = of(commit, "_gone")
        for old in [x.getPath().getName() for x in fs.listStatus(gone)] if fs.exists(gone) else []:
            fs.delete(of(f"{path}/{old}"), True)
        fs.delete(commit, True)


def _moved(fs, new, old) -> None:
    """new in the place of old. While new is where it was written, old may be there or not."""
    fs.delete(old, True)
    fs.rename(new, old)


def upsert(rows: DataFrame, path: str) -> None:
    """Replace the documents in rows, keep the others."""
    new = stored(rows, "vector-new")
    _rewrite(rows.sparkSession, path, new, new)
    discard(new)


def delete(rows: DataFrame, path: str, ids: list) -> int:
    """Rewrite a table without some documents; the number of rows that went."""
    gone = rows.where(F.col("document_id").isin(ids)).count()
    of = T.StructType([T.StructField("document_id", rows.schema["document_id"].dataType)])
    _rewrite(rows.sparkSession, path, rows.sparkSession.createDataFrame([(i,) for i in ids], of), None)
    return gone


def prompt(contexts: DataFrame, question: str, most: int = 3) -> DataFrame:
    """One row: numbered contexts (title, similarity, 300 characters) in order of similarity, and the question."""
    line = F.format_string("[%d] %s (%.2f): %s", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")), F.coalesce("title", F.lit("untitled")), "similarity", F.substring("content", 1, 300))
    top = contexts.orderBy(F.desc("similarity"), "id").limit(most)  # few rows: one task is enough
    lines = top.select(F.struct((-F.col("similarity")).alias("o"), "id", line.alias("l")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n")
    return lines.agg(F.concat(body, F.lit(f"\n\n{question}")).alias("prompt"))


# -- keywords ----------------------------------------------------------------------------------------------------------


def top_terms(docs: DataFrame, most: int = 8, key: str = "doc_id", text: str = "text", shortest: int = 2) -> DataFrame:
    """(key, term, n, rank): the most frequent words of each text; ties in alphabetical order."""
    words = F.filter(F.split(X.normalise(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= shortest)
    counts = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Words that are counted at once.
WORDS = 100_000


def leading_terms(text: Column, most: int = 8, shortest: int = 2) -> Column:
    """The terms of `top_terms` in order, as an array: counted within the row, nothing is shuffled."""
    words = F.filter(F.split(X.normalise(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= shortest)

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                counts = (Counter(ws or []) for ws in part.slice(a, b - a).to_pylist())
                yield pa.array([sorted(n, key=lambda w: (-n[w], w))[:most] for n in counts], pa.list_(pa.string()))

    return run(words)


def frequent_words(docs: DataFrame, classes: tuple[str, ...], most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, n, rank): the most frequent words of some classes; of equally frequent ones the first in the text."""
    from millrace.operators.models import word_class

    words = docs.select(key, F.posexplode(F.split(X.normalise(F.col(text)), r"[^\p{L}\p{N}_]+")).alias("at", "term")).where(word_class(F.col("term")).isin(*classes))
    counts = words.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("at")


def class_keywords(docs: DataFrame, most: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Nouns, verbs and adjectives: twice as many as asked for."""
    return frequent_words(docs, ("n", "v", "a"), 2 * most, key, text)


def short_keywords(docs: DataFrame, most: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Nouns alone, for short texts."""
    return frequent_words(docs, ("n",), most, key, text)


def fuse(sets: DataFrame, most: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, term, score): sets (key, set number, terms in order) fused by position, half a point a place from the end.

    Ordered by score, then set and place; a term within an already chosen one is left out.
    """
    each = sets.select(key, "set", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    scored = each.groupBy(key, "term").agg(F.sum((F.col("n") - F.col("at")) * 0.5).alias("score"), F.min(F.struct("set", "at")).alias("seen"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "seen", "term", "score")))
    lists = scored.groupBy(key).agg(order.alias("c"))
    start = F.array().cast("array<struct<o:double,seen:struct<set:int,at:int>,term:string,score:double>>")
    chosen = F.aggregate("c", start, lambda out, x: F.when((F.size(out) < most) & ~F.exists(out, lambda y: F.contains(y["term"], x["term"])), F.concat(out, F.array(x))).otherwise(out))
    return lists.select(key, F.explode(chosen).alias("x")).select(key, "x.term", "x.score")


def fused(sets: list[list[str]], most: int) -> list[tuple[str, float]]:
    """`fuse` for the sets of one text."""
    score: dict[str, float] = {}
    for terms in sets:  # a dict keeps the order in which terms are seen first: by set, then place
        for at, w in enumerate(terms):
            score[w] = score.get(w, 0.0) + (len(terms) - at) * 0.5
    chosen: list[str] = []
    for w in sorted(score, key=lambda w: -score[w]):
        if len(chosen) == most:
            break
        if not any(w in c for c in chosen):
            chosen.append(w)
    return [(w, score[w]) for w in chosen]


def ranked_words(words: list[str], most: int, window: int = 4, rounds: int = 20) -> list[tuple[str, float]]:
    """The words of one text with the highest PageRank, and their ranks."""
    names = sorted({w for w in words if len(w) > 2})
    at = {w: i for i, w in enumerate(names)}
    ids = np.array([at.get(w, -1) for w in words], np.int64)
    src, dst = [], []
    for d in range(1, window):
        a, b = ids[:-d], ids[d:]
        ok = (a >= 0) & (b >= 0) & (a != b)
        src += [a[ok], b[ok]]
        dst += [b[ok], a[ok]]
    if not names or not src:
        return []
    s, d = np.concatenate(src), np.concatenate(dst)
    degree = np.maximum(1, np.bincount(s, minlength=len(names)))
    rank = np.ones(len(names))
    for _ in range(rounds):
        rank = 0.15 + 0.85 * np.bincount(d, weights=rank[s] / degree[s], minlength=len(names))
    best = sorted(zip((-np.round(rank, 9)).tolist(), names, rank.tolist(), strict=True))[:most]
    return [(w, x) for _, w, x in best]


def text_rank(docs: DataFrame, most: int = 8, window: int = 4, rounds: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, score): PageRank over words that occur within `window` words of each other, text by text."""

    @F.pandas_udf("array<struct<term:string,score:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[{"term": w, "score": x} for w, x in ranked_words(list(words) if words is not None else [], most, window, rounds)] for words in part], dtype="object")

    words = F.array_remove(F.split(X.normalise(F.col(text)), r"[^\p{L}\p{N}_]+"), "")
    return docs.select(key, F.explode(run(words)).alias("x")).select(key, "x.term", "x.score")


def cluster_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 10) -> DataFrame:
    """(key, cluster, sentence): of each text the sentence nearest to each cluster's centre; min(5, max(1, n / 3)) clusters."""
    from millrace.operators.chunk import kmeans, split_sentences
    from millrace.operators.models import embed

    @F.pandas_udf("array<struct<cluster:int,sentence:string>>")
    def run(parts: pd.Series) -> pd.Series:
        out = []
        for t in parts:
            ss = [s for s in split_sentences(t or "") if len(s) > shortest]
            if not ss:
                out.append([])
                continue
            m = np.array([embed(s) for s in ss])
            own = kmeans(m, min(5, max(1, len(ss) // 3)))
            got = []
            for c in sorted(set(own.tolist())):
                at = np.flatnonzero(own == c)
                got.append({"cluster": int(c), "sentence": ss[int(at[((m[at] - m[at].mean(0)) ** 2).sum(1).argmin()])]})
            out.append(got)
        return pd.Series(out)

    return docs.select(key, F.explode(run(F.col(text))).alias("x")).select(key, "x.cluster", "x.sentence")


def keywords(docs: DataFrame, most: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, score): frequent words, ranked words and names of each text, fused by position."""
    from millrace.operators.models import WORD, names

    # all of it comes from one text: its words are not exploded, counted and put together again by shuffles
    @F.pandas_udf("array<struct<term:string,score:double>>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lower, named in parts:
            out = []
            for t, own in zip(lower, named, strict=True):
                words = WORD.findall(t or "")
                n = Counter(w for w in words if len(w) >= 5)
                frequent = sorted(n, key=lambda w: (-n[w], w))[: 2 * most]
                ranked = [w for w, _ in sorted(ranked_words(words, 2 * most), key=lambda x: (-x[1], x[0]))]
                out.append([{"term": w, "score": x} for w, x in fused([frequent, ranked, list(own) if own is not None else []], most)])
            yield pd.Series(out, dtype="object")

    found = run(F.lower(text), F.slice(F.transform(names(F.col(text)), F.lower), 1, most))
    return docs.select(key, F.explode(found).alias("x")).select(key, "x.term", "x.score")
