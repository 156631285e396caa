"""What Python tasks hold does not grow with the batches they get; greedy rounds end in one task."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunk as C
from millrace.operators import dedup as D
from millrace.operators import tokenizers as K


def test_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 10)
    given = ["abc", None, "", "defgh", "x" * 40, "y", "zz", None]
    got = [p.to_pylist() for p in C.pieces(pa.array(given, pa.string()))]
    assert [t for p in got for t in p] == given and len(got) > 2
    assert list(C.pieces(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_pieces_change_no_result(spark, monkeypatch, size):
    monkeypatch.setattr(C, "PIECE", size)
    monkeypatch.setattr(K, "WORDS", size)
    texts = [(k, None if k == 3 else "" if k == 4 else f"One two {k}. Three four!\n\nFive six {k}? Seven.") for k in range(50)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in df.select("doc_id", C.applied(C.semantic_units, F.col("text")).alias("c")).orderBy("doc_id").collect()]
    assert got == [(k, C.semantic_units(t) if t else []) for k, t in texts]
    nodes = sorted((tuple(r) for r in C.document_tree(df).collect()), key=repr)
    assert nodes == sorted(((k, *n) for k, t in texts for n in C.tree(k, t or "")), key=repr)
    words = df.select("doc_id", F.split("text", " ").alias("w"))
    got = {r[0]: r[1] for r in words.select("doc_id", K.apply_words(F.col("w"), list)).collect()}
    assert got == {k: [c for w in (t.split(" ") if t is not None else []) for c in w] for k, t in texts}


def test_what_a_task_gets_is_cut(monkeypatch, spark):
    """A batch of many texts is never turned into results as a whole."""
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(2000).select(F.concat(F.repeat(F.lit("word "), 400), F.col("id").cast("string")).alias("t")).coalesce(1)

    def longest(text):
        seen.add(1)
        return [text]

    assert df.select(C.applied(longest, F.col("t")).alias("c")).where(F.size("c") == 1).count() == 2000
    assert len(list(C.pieces(pa.array(["x" * 2000] * 2000)))) > 3


def test_windows_are_handed_on(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(40)], "doc_id long, text string").coalesce(1)
    want = sorted(tuple(r) for r in D.window_hashes(df, 20).collect())
    monkeypatch.setattr(D, "WINDOWS", 25)
    assert sorted(tuple(r) for r in D.window_hashes(df, 20).collect()) == want and len(want) == 40 * 11


def test_greedy_rounds_end_in_one_task(spark, monkeypatch):
    path = [(k, k + 1) for k in range(120)]  # a chain takes a round for every second id
    rounds = []
    real = D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: (rounds.append(name), real(df, name))[1])
    ids = spark.range(121).select(F.col("id").alias("v"))
    got = sorted(r["v"] for r in D.greedy_survivors(ids, spark.createDataFrame(path, "i long, j long"), small=117).collect())
    assert got == list(range(0, 121, 2))
    assert rounds.count("greedy-kept") < 5


def test_optimised_chunks_are_made_one_by_one(spark):
    item = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))
    rows = [(k // 3, k % 3, f"pears  pears\tand　apples grow in garden {k} ", "pears") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, chunk string, a string")
    twice = df.union(df.where("ord = 2"))  # a chunk that is given twice comes twice, not four times
    got = C.optimised(twice, F.array(item("a")), F.array(item("a")), F.array(F.lit("given")))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    out = got.collect()
    assert len(out) == 12 and {r["content"] for r in out} == {f"pears pears and apples grow in garden {k}" for k in range(9)}
    assert all(r["keywords"][:7] == ["pears", "and", "apples", "garden", "grow", "in", "given"] for r in out)


def test_hashes_of_links_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(h):
        made.add(1)
        return h

    seen = seen.asNondeterministic()
    df = spark.createDataFrame([(k, k % 30, k % 10) for k in range(60)], "doc_id long, hi long, lo long")
    links = D.simhash_links(df.select("doc_id", seen("hi").alias("hi"), "lo"), 3).collect()
    assert made.value == 60 and {r["distance"] for r in links} == {0, 2, 3}


@pytest.mark.parametrize("size", [1, 7, 20])
def test_texts_that_share_a_window_share_a_run(spark, size):
    rng = random.Random(size)
    words = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    for k in range(60):  # the words of one text, with a stretch of another
        a, b, at, n = rng.choice(words), rng.choice(words), rng.randrange(40), rng.randrange(5, 25)
        words.append(a[:at] + b[at : at + n] + a[at + n :])
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string")
    kept: list[int] = []
    first = {" ".join(w): k for k, w in reversed(list(enumerate(words)))}
    of = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    for k, w in enumerate(words):
        if first[" ".join(w)] == k and not any(len(words[j]) == len(w) and of(words[j]) & of(w) for j in kept):
            kept.append(k)
    assert sorted(r["doc_id"] for r in D.window_dedup(df, size).collect()) == kept
    if size == 20:
        assert D.window_runs(df, size).count() < 0.5 * D.window_hashes(df, size).count()
