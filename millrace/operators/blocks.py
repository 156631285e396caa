"""Exact search and exact joins over blocks of similar vectors, of which those that cannot matter are never read.

Rows get the nearest of some centres (fitted on a bounded sample; the results do not depend on them) and are range-sorted
by centre and distance to it. A block is a run of at most BLOCK rows of a cell: a ring around its centre. Of a block are
known the smallest and the largest distance of its rows to every centre. By the triangle inequality two rows are at
least as far apart as their distances to any centre differ, so the gap between the intervals of two blocks bounds the
distances of all pairs of their rows from below. Pairs of blocks whose bound exceeds what is asked are dropped before
any vector is moved; what is left is joined block by block, and compared by matrix products.

How much is dropped depends on the data: nearly all for vectors in clusters, hardly any for vectors that point everywhere
alike, as unit vectors of many random dimensions do. Summaries are compared group by group, so the work to find the pairs
of blocks is quadratic in the number of blocks; a block stands for up to BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import discard, stored

#: Rows of a block, block summaries that are compared at once, rows that centres are fitted on.
BLOCK, GROUP, SAMPLE = 1024, 512, 20_000
#: Blocks that a block of queries looks at first, for a bound on how far its nearest rows are.
FIRST = 4
#: Distances are computed in floating point: what a bound may be off.
SLACK = 1e-6

BLOCKS = "b long, cell int, n int, ids binary, xs binary, low binary, high binary, mean binary"


def centres_of(vectors: DataFrame, cells: int, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, unit: bool = False, seed: int = 42) -> np.ndarray:
    """k-means centres of at most `sample` rows, those of the smallest hashes of their ids."""
    some = vectors.select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(sample).select(vector).toPandas()[vector]
    if not len(some):
        return np.zeros((0, 0))
    x = _matrix(some, unit)
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        own = _nearest(x, c)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def _matrix(column: pd.Series, unit: bool) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(float)
    return x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1) if unit else x


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None]))


def blocked(vectors: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding", unit: bool = False, size: int = BLOCK) -> DataFrame:
    """BLOCKS of the rows; low, high: the least and the largest distance to each centre. Written to the shared folder."""

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = _matrix(part["x"], unit)
                cell = _nearest(x, centres)
                yield pd.DataFrame({"v": part["v"], "cell": cell.astype("int32"), "d": np.linalg.norm(x - centres[cell], axis=1), "x": [r.tobytes() for r in x]})

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part_id, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> tuple:
            x = np.frombuffer(b"".join(r[2] for r in held)).reshape(len(held), -1)
            d = _apart(x, centres)
            ids = np.array([r[0] for r in held], np.int64)
            return (part_id << 32) + made, held[0][1], len(held), ids.tobytes(), x.tobytes(), d.min(0).tobytes(), d.max(0).tobytes(), x.mean(0).tobytes()

        for part in parts:
            out = []
            for row in zip(part["v"].tolist(), part["cell"].tolist(), part["x"], strict=True):
                if held and (held[0][1] != row[1] or len(held) == size):
                    out.append(block())
                    made, held = made + 1, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])
        if held:
            yield pd.DataFrame([block()], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    rows = vectors.select(F.col(key).cast("long").alias("v"), F.col(vector).alias("x")).where("v is not null and x is not null")
    near = stored(rows.mapInPandas(placed, "v long, cell int, d double, x binary"), "blocks-placed")
    out = stored(near.repartitionByRange("cell", "d", "v").sortWithinPartitions("cell", "d", "v").mapInPandas(cut, BLOCKS), "blocks")
    discard(near)
    return out


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data)


def _gaps(a: list, b: list) -> np.ndarray:
    """Lower bounds of the distances between rows of each block of a and of b, from their (low, high)."""
    la, ha, lb, hb = (np.stack([_array(r[c]) for r in rows]) for rows, c in ((a, "low"), (a, "high"), (b, "low"), (b, "high")))
    out = np.zeros((len(a), len(b)))
    for k in range(la.shape[1]):
        np.maximum(out, la[:, None, k] - hb[None, :, k], out=out)
        np.maximum(out, lb[None, :, k] - ha[:, None, k], out=out)
    return out


def _groups(blocks: DataFrame, n: int, more: list[str], name: str) -> DataFrame:
    """Summaries in groups of about GROUP: (name, rows)."""
    k = max(1, -(-n // GROUP))
    return blocks.groupBy(F.pmod(F.xxhash64("b"), F.lit(k)).alias(name)).agg(F.collect_list(F.struct("b", "low", "high", "mean", *more)).alias(f"{name}_rows"))


def block_pairs(left: DataFrame, right: DataFrame, limit: float | None = None, same: bool = False, first: int | None = None) -> DataFrame:
    """(p, q): the pairs of blocks whose rows may be within `limit`, or within the left block's own limit (column `far`).

    same: left and right are one table, and of (p, q) and (q, p) one is left. first: of each left block the `first` right
    ones with the nearest means instead. Written to the shared folder.
    """
    nl, nr = left.count(), right.count()
    groups = _groups(right, nr, [], "gq").withColumn("at", F.col("gq"))
    every = _groups(left, nl, ["far"] if limit is None and first is None else [], "gp").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-nr // GROUP)) - 1))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a, b in zip(part["gp_rows"], part["gq_rows"], strict=True):
                pa, pb = (np.array([r["b"] for r in rows], np.int64) for rows in (a, b))
                if first is not None:
                    d = _apart(*(np.stack([_array(r["mean"]) for r in rows]) for rows in (a, b)))
                    i, j = (x.ravel() for x in np.broadcast_arrays(np.arange(len(a))[:, None], np.argsort(d, axis=1, kind="stable")[:, :first]))
                    yield pd.DataFrame({"p": pa[i], "q": pb[j], "d": d[i, j]})
                    continue
                far = np.full(len(a), limit) if limit is not None else np.array([r["far"] for r in a], float)
                keep = _gaps(a, b) <= far[:, None] + SLACK
                if same:
                    keep &= pa[:, None] <= pb[None]
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"p": pa[i], "q": pb[j], "d": np.zeros(len(i))})

    found = every.join(groups, "at").select("gp_rows", "gq_rows").mapInPandas(run, "p long, q long, d double")
    if first is not None:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("d", "q"))).where(F.col("r") <= first)
    return stored(found.select("p", "q"), "block-pairs")


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame, more: list[str] | None = None) -> DataFrame:
    a = left.select(F.col("b").alias("p"), F.col("ids").alias("ids_p"), F.col("xs").alias("xs_p"), *(more or []))
    b = right.select(F.col("b").alias("q"), F.col("ids").alias("ids_q"), F.col("xs").alias("xs_q"))
    return pairs.join(a, "p").join(b, "q").select("p", "ids_p", "xs_p", *(more or []), "q", "ids_q", "xs_q")


def _rows(ids: bytes, xs: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(ids, np.int64)
    return v, _array(xs).reshape(len(v), -1)


#: Rows that a group of blocks has at most, and groups that blocks are put in at least (as far as there are blocks).
GROUP_ROWS, GROUPS = 65_536, 16
#: Pairs that a task holds before it reduces them.
HELD = 2_000_000


def _tiled(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, q, kind, b, c, ids, xs): for each pair of groups of blocks its blocks (kind 0), each once, then its pairs of blocks (kind 1).

    A block is sent to as many tasks as there are groups, not once for every other block: while groups are within
    GROUP_ROWS, what is moved grows with the rows.
    """
    rows, n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    k = max(GROUPS, -(-rows // GROUP_ROWS))
    group = lambda b: F.pmod(F.xxhash64(b), F.lit(k))
    met = pairs.select(F.least(group("p"), group("q")).alias("gp"), F.greatest(group("p"), group("q")).alias("gq"), F.col("p").alias("b"), F.col("q").alias("c"))
    asked = met.select("gp", "gq", F.explode(F.array("b", "c")).alias("b")).distinct()
    own = asked.join(blocks.select("b", "ids", "xs"), "b").select("gp", "gq", F.lit(0).alias("kind"), "b", F.col("b").alias("c"), "ids", "xs")
    none = F.lit(None).cast("binary")
    tasks = max(1, min(1024, k * (k + 1), n * (n + 1) // 2))
    return own.union(met.select("gp", "gq", F.lit(1), "b", "c", none, none)).repartition(tasks, "gp", "gq").sortWithinPartitions("gp", "gq", "kind")


def _close(blocks: DataFrame, pairs: DataFrame, threshold: float, first: Callable[..., tuple] | None, again: Callable[..., tuple] | None, names: str) -> DataFrame:
    """(i, j, cosine) above a threshold of the rows of pairs of blocks of unit vectors, i < j, reduced tile by tile.

    first: arrays (i, j, cosine) of two blocks to the columns `names`; again: some of these to fewer, at the end of a tile
    and whenever HELD rows are held. None: all pairs are passed on.
    """
    columns = [c.split()[0] for c in names.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, got, n = None, {}, [], 0

        def packed() -> tuple:
            return again(*(np.concatenate(x) for x in zip(*got, strict=True)))

        for part in parts:
            for gp, gq, kind, p, q, ids, xs in part.itertuples(index=False):
                if (gp, gq) != here:
                    if got:
                        yield pd.DataFrame(dict(zip(columns, packed(), strict=True)))
                    here, held, got, n = (gp, gq), {}, [], 0
                if kind == 0:
                    held[p] = _rows(ids, xs)
                    continue
                (va, a), (vb, b) = held[p], held[q]
                c = a @ b.T
                i, j = np.nonzero(c > threshold)
                keep = va[i] < vb[j] if p == q else va[i] != vb[j]
                i, j = i[keep], j[keep]
                found = np.minimum(va[i], vb[j]), np.maximum(va[i], vb[j]), c[i, j]
                if first is None:
                    yield pd.DataFrame(dict(zip(columns, found, strict=True)))
                elif len(i):
                    got.append(first(*found))
                    n += len(got[-1][0])
                    if n > HELD:
                        got = [packed()]
                        n = len(got[0][0]) // 2  # what is left is not reduced again at once
        if got:
            yield pd.DataFrame(dict(zip(columns, packed(), strict=True)))

    return _tiled(blocks, pairs).mapInPandas(run, names)


def close_pairs(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(i, j, cosine) above a threshold, of the rows of pairs of blocks of unit vectors."""
    return _close(blocks, pairs, threshold, None, None, "i long, j long, cosine double")


def near_pairs(blocks: DataFrame, pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """(i, j, cosine) of `close_pairs` in both directions: of each tile the k largest cosines of every i; ties: the smallest j."""

    def best(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple:
        order = np.lexsort((j, -c, i))
        i, j, c = i[order], j[order], c[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
        return i[keep], j[keep], c[keep]

    def first(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple:
        return best(np.r_[i, j], np.r_[j, i], np.r_[c, c])

    return _close(blocks, pairs, threshold, first, best, "i long, j long, cosine double")


def close_links(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(v, first, n): of each tile every row with a pair of `close_pairs`, the smallest id it is linked to there, and its pairs there."""

    def linked(v: np.ndarray, u: np.ndarray, n: np.ndarray) -> tuple:
        ids, at = np.unique(np.r_[v, u], return_inverse=True)
        a, b = at[: len(v)], at[len(v) :]
        label = np.arange(len(ids))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                return ids, ids[label], np.bincount(a, n, len(ids)).astype(np.int64)
            label = low

    def first(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple:
        return linked(np.r_[i, j], np.r_[j, i], np.ones(2 * len(i)))

    return _close(blocks, pairs, threshold, first, linked, "v long, first long, n long")


def _within(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int, exact: bool) -> DataFrame:
    """(query, v, distance): of each pair of blocks the k nearest rows of every query, ties included; exact: those within its `bound`."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, ip, xp, *bound, _, iq, xq in part.itertuples(index=False):
                (va, a), (vb, b) = _rows(ip, xp), _rows(iq, xq)
                d = _apart(a, b)
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(a), np.inf)
                if exact:
                    last = np.minimum(last, _array(bound[0]))
                i, j = np.nonzero(d <= last[:, None] + SLACK)
                yield pd.DataFrame({"query": va[i], "v": vb[j], "distance": np.sqrt(((a[i] - b[j]) ** 2).sum(1))})

    return _met(pairs, queries, rows, ["bound"] if exact else None).mapInPandas(run, "query long, v long, distance double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy("distance", "v")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_rows(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, v, distance, rank): the k nearest rows of every query, exactly; ties go to the smaller id. Both are `blocked`.

    Every block of queries is first compared with the FIRST blocks that are nearest: the k-th distance there bounds how
    far the rows of each query can be, and the largest in the block how far a block of rows may be to be read at all.
    """
    before = block_pairs(queries, rows, first=FIRST)
    kth = stored(_top(_within(before, queries, rows, k, False), k).groupBy("query").agg(F.max("distance").alias("d"), F.count("*").alias("n")), "nearest-first")

    def bound(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for b, ids, known in zip(part["b"], part["ids"], part["known"], strict=True):
                d = {r["query"]: r["d"] for r in known} if known is not None else {}
                each = np.array([d.get(v, np.inf) for v in np.frombuffer(ids, np.int64).tolist()])
                out.append((b, each.tobytes(), float(each.max())))
            yield pd.DataFrame(out, columns=["b2", "bound", "far"])

    each = queries.select("b", F.explode(_unpacked("ids")).alias("query")).join(kth.where(F.col("n") >= k), "query")
    known = each.groupBy("b").agg(F.collect_list(F.struct("query", "d")).alias("known")).withColumnRenamed("b", "b2")  # at most BLOCK
    bounds = queries.select("b", "ids").join(known, F.col("b") == F.col("b2"), "left").select("b", "ids", "known").mapInPandas(bound, "b2 long, bound binary, far double")
    asked = stored(queries.join(bounds, F.col("b") == F.col("b2")).drop("b2"), "nearest-asked")
    discard(before, kth)
    return _top(_within(block_pairs(asked, rows), asked, rows, k, True), k).select("query", "v", "distance", "rank")


def _unpacked(column: str):
    @F.pandas_udf("array<long>")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in part], dtype="object")

    return run(column)


def cells_read(rows: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(b, cells, rows): how many cells and rows the pairs of blocks make a block of queries read."""
    a, b = queries.select(F.col("b").alias("p")), rows.select(F.col("b").alias("q"), "cell", "n")
    return pairs.join(a, "p").join(b, "q").groupBy(F.col("p").alias("b")).agg(F.count_distinct("cell").alias("cells"), F.sum("n").alias("rows"))
