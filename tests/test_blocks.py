"""Blocks of vectors: exact results whatever the centres, and few blocks read where vectors lie in clusters."""

import numpy as np
import pytest

from millrace.operators import blocks as B
from millrace.operators import dedup as D
from millrace.operators import vector as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(seed, n, dims=16, clusters=20, wide=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims))
    return middle[rng.integers(0, clusters, n)] + wide * rng.normal(size=(n, dims))


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(x)], SCHEMA)


def plain_nearest(x, ids, k):
    out = {}
    for q in ids:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[q] = [(int(v), round(float(d[v]), 9)) for v in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["vec_id"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("wide, n", [(0.02, 3000), (5.0, 700), (0.0, 300)])
def test_search_is_exact(spark, monkeypatch, wide, n):
    monkeypatch.setattr(B, "GROUP", 16)
    x = clustered(1, n, wide=wide)  # wide 0: copies, so that all is ties
    df = frame(spark, x)
    index = V.cell_index(df, 20)
    assert found(V.search_exact(index, df.where("vec_id % 20 = 0"), 5)) == plain_nearest(x, range(0, n, 20), 5)


def test_few_cells_are_read_of_clusters(spark):
    x = clustered(2, 4000)
    df = frame(spark, x)
    centres, rows = V.cell_index(df, 20)
    asked = B.blocked(df.where("vec_id % 20 = 0"), centres)
    from pyspark.sql import functions as F

    pairs = B.block_pairs(asked.withColumn("far", F.lit(0.5)), rows)
    read = B.cells_read(rows, asked, pairs).collect()
    assert sum(r["cells"] for r in read) / len(read) <= 4 and sum(r["rows"] for r in read) <= 0.2 * 4000 * len(read)


@pytest.mark.parametrize("threshold", [0.9, 0.35, -0.2])
def test_pairs_are_exact_and_few_blocks_are_shipped(spark, monkeypatch, threshold):
    monkeypatch.setattr(D, "CELL_ROWS", 20)
    x = np.vstack([clustered(3, 600), np.zeros((2, 16))])
    df = frame(spark, x)
    unit = x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1)
    c = unit @ unit.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] > threshold}
    assert {(r["i"], r["j"]) for r in D.vector_pairs(df, threshold).collect()} == want
    if threshold == 0.9:
        blocks = B.blocked(df, B.centres_of(df, 30, unit=True), unit=True)
        n = blocks.count()
        shipped = B.block_pairs(blocks, blocks, float(np.sqrt(0.2)), same=True).count()
        assert n >= 20 and shipped < 0.25 * n * (n + 1) / 2


def test_empty_and_odd_rows(spark):
    none = frame(spark, np.zeros((0, 3)))
    assert D.vector_pairs(none, 0.5).count() == 0 and V.search_exact(V.cell_index(none), none).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, None, 0), (3, [1.0, 0.0], 0)], SCHEMA)
    got = found(V.search_exact(V.cell_index(some.where("vec_id is not null and embedding is not null"), 4), some.where("vec_id = 1"), 5))
    assert got == {1: [(1, 0.0), (3, 0.0)]}


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_blocks_are_sent_once_a_group_and_pairs_reduced_where_found(spark, monkeypatch, held):
    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "GROUPS", 3)
    x = np.vstack([clustered(7, 300, wide=0.4), np.zeros((2, 16))])
    df = frame(spark, x)
    blocks = B.blocked(df, B.centres_of(df, 4, unit=True), unit=True, size=10)
    met = B.block_pairs(blocks, blocks, float("inf"), same=True)
    n = blocks.count()
    assert n > 20 and B._tiled(blocks, met).where("kind = 0").count() <= 3 * n  # not once for each of n blocks
    unit = x / np.where((s := np.linalg.norm(x, axis=1, keepdims=True)) > 0, s, 1)
    c = unit @ unit.T
    np.fill_diagonal(c, -1)
    near = c > 0.6
    links = B.close_links(blocks, met, 0.6).collect()
    assert {v: sum(r["n"] for r in links if r["v"] == v) for v in {r["v"] for r in links}} == {v: int(k) for v, k in enumerate(near.sum(1)) if k}
    label = np.arange(len(x))
    for _ in x:
        label = np.minimum(label, np.where(near, label[None], len(x)).min(1))
    got = {r["v"]: r["comp"] for r in D.components(spark.createDataFrame(links).selectExpr("first as i", "v as j")).collect()}
    assert got == {v: int(label[v]) for v in range(len(x)) if near[v].any()}
    best = {}
    for r in sorted(B.near_pairs(blocks, met, 0.6, 4).collect(), key=lambda r: (-r["cosine"], r["j"])):
        best.setdefault(r["i"], []).append(r["j"])
    assert {i: js[:4] for i, js in best.items()} == {i: [int(j) for j in np.argsort(-c[i], kind="stable")[: min(4, near[i].sum())]] for i in range(len(x)) if near[i].any()}
