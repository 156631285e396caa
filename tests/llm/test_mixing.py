"""Mixing against a plain loop over all documents: targets, cuts, repeated rows, the texts themselves."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import mixing  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(rows, weight_of, share=Fraction(3, 2), most=2, seed="13"):
    """(targets by source, words taken by (doc_id, source, size)) of rows (doc_id, source, text)."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    size = Counter()
    for _, s, n in sized:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weight_of(k, s) for k, s in enumerate(names)}
    total, full = share * sum(size.values()), set()
    while True:
        left = [s for s in names if s not in full]
        rest, w = total - sum(most * size[s] for s in full), sum(weight[s] for s in left)
        over = {s for s in left if w and rest * weight[s] > w * most * size[s]}
        if not over:
            break
        full |= over
    target = {s: Fraction(most * size[s]) if s in full or not w else rest * weight[s] / w for s in names}
    key = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:16]
    groups = defaultdict(Counter)
    for i, s, n in sized:
        groups[s][(key(i), i is not None, i, n)] += 1
    taken = {}
    for s in names:
        budget = int(target[s] + Fraction(1, 2))
        epochs, at = (budget // size[s], budget % size[s]) if size[s] else (0, 0)
        for _, _, i, n in sorted(groups[s]):
            m = groups[s][(key(i), i is not None, i, n)]
            taken[i, s, n] = n * epochs + min(max(at, 0), m * n) // m
            at -= m * n
    return target, taken


def check(spark, rows, weight_of=lambda k, s: (5, 2, 1)[k % 3], **how):
    docs = spark.createDataFrame([(i, s, t, 1, "k", 0.5) for i, s, t in rows], "doc_id long, source string, text string, size int, key string, cut double").repartition(5)
    got = mixing.plan(docs, **how).collect()
    target, taken = plainly(rows, weight_of, share=Fraction(how.get("share", 1.5)), most=how.get("most", 2))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, s, t in rows)
    for r in got:
        assert r["target"] == pytest.approx(float(target[r["source"]]), rel=1e-12)
        assert r["taken"] == taken[r["doc_id"], r["source"], r["size"]] <= how.get("most", 2) * r["size"]
    return docs, got


def words(k, n):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_weights_limits_and_cuts(spark):
    rows = [(k, f"s{k % 7}", words(k, 1 + k * k % 23)) for k in range(400)] + [(k, "hot", words(k, 9)) for k in range(400, 900)]
    _, got = check(spark, rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    check(spark, rows, share=0.3)
    check(spark, rows, share=4.2, most=5)
    check(spark, rows, share=2.0)  # all sources at their limits


def test_odd_rows(spark):
    long = words(0, 60_000)
    rows = [(1, "a", None), (2, "a", ""), (3, "b", " \t\n "), (4, None, "x y"), (None, None, "z z z"), (5, "long", long), *[(6, "c", "same same text")] * 50, (7, "c", "one"), (8, "\U0001f600", "emoji one"), (9, "￿", "bmp two words"), (10, "A", "p q r")]
    check(spark, rows)
    docs, _ = check(spark, [])
    assert mixing.mixed(docs).count() == 0


def test_given_weights(spark):
    weights = spark.createDataFrame([("s0", 3), ("s1", 1)], "source string, weight long")
    rows = [(k, f"s{k % 3}", words(k, 5)) for k in range(60)]
    _, got = check(spark, rows, lambda k, s: {"s0": 3, "s1": 1}.get(s, 0), weights=weights, share=0.5)
    assert all(r["taken"] == 0 for r in got if r["source"] == "s2")


def test_texts_of_the_mix(spark):
    rows = [(k, f"s{k % 4}", "  " + "\n ".join(words(k, 1 + k % 11).split()) + " ") for k in range(120)] + [(3, "s3", "x y z")] * 3
    docs, got = check(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "epoch"]
    have = defaultdict(int)
    for r in out.collect():
        assert any(t.startswith(r["text"]) for i, s, t in rows if (i, s) == (r["doc_id"], r["source"]))
        have[r["source"]] += len(WORD.findall(r["text"]))
    want = defaultdict(int)
    for r in got:
        want[r["source"]] += r["taken"]
    assert have == want
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mixed(docs.repartition(3)).collect()))
