"""METEOR alignments and gazetteers against brute force, layers against plain matrices."""

import random
from itertools import product

import numpy as np
import pytest

from millrace.operators import alignment as A
from millrace.operators import gazetteer as G
from millrace.operators import layers as L


def brute(c, r):
    """The best (matches, chunks) of all assignments."""
    best = None
    options = [[None, *[j for j, w in enumerate(r) if w == x or A.stem(w) == A.stem(x)]] for x in c]
    for pick in product(*options):
        used = [j for j in pick if j is not None]
        if len(used) != len(set(used)):
            continue
        exact = sum(j is not None and r[j] == c[i] for i, j in enumerate(pick))
        chunks = sum(j is not None and (i == 0 or pick[i - 1] is None or pick[i - 1] + 1 != j) for i, j in enumerate(pick))
        key = (-exact, -(len(used) - exact), chunks)
        best = key if best is None or key < best else best
    return -best[0] - best[1], best[2]


@pytest.mark.parametrize("seed", range(40))
def test_fewest_chunks(seed):
    rng = random.Random(seed)
    words = ["cat", "cats", "the", "running", "runs", "run"]
    c, r = rng.choices(words, k=rng.randrange(7)), rng.choices(words, k=rng.randrange(7))
    assert A.aligned(c, r, 10**6) == brute(c, r)
    assert A.aligned(c, r)[0] == brute(c, r)[0]


def test_stems_and_values(spark):
    assert [A.stem(w) for w in ("caresses", "ponies", "cats", "feed", "agreed", "plastered", "motoring", "sing", "hopping", "falling", "filing", "happy", "sky", "is")] == ["caress", "poni", "cat", "feed", "agree", "plaster", "motor", "sing", "hop", "fall", "file", "happi", "sky", "is"]
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("cats", "cat"), ("a", "b"), (None, "x"), ("", "")], "c string, r string")
    got = [r[0] for r in df.select(A.meteor(df.c, df.r)).collect()]
    assert got == pytest.approx([1 - 0.5 / 27, 0.5, 0.0, 0.0, 0.0])


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_gazetteer_is_a_scan(spark, monkeypatch, longest, limit):
    monkeypatch.setattr(G, "BROADCAST_NAMES", limit)
    monkeypatch.setattr(G, "MANY", 2)
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choices(["New", "york", "City", "hall", "new,", "x"], k=rng.randrange(25)))) for k in range(40)] + [(100, None), (101, "")]
    names = [("new york", "place"), ("New York City", "place"), ("york city hall", "house"), ("new new", "odd"), ("new x", "odd"), ("hall", "house"), ("new", "word"), ("NEW YORK", "team"), ("--", "none"), ("not there", "none")]
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    want = []
    for k, t in docs:
        ws = split(t)
        at = [(i, len(n), name, kind) for name, kind in names if (n := split(name)) for i in range(len(ws)) if ws[i : i + len(n)] == n]
        for i, n, name, kind in at:
            if not longest or not any(a <= i and i + n <= a + b and b > n for a, b, *_ in at):
                want.append((k, name, kind, i, n))
    got = G.named(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "name string, kind string"), longest=longest)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_decoder_layer_is_plain_matrices(spark):
    rng = np.random.default_rng(0)
    shapes = {"q": (8, 6), "k": (4, 6), "v": (4, 6), "o": (6, 8), "gate": (5, 6), "up": (5, 6), "down": (6, 5)}
    w = {n: rng.normal(size=s) for n, s in shapes.items()}
    bias = {n: rng.normal(size=s[0]) for n, s in shapes.items()}
    rows = [(n, o, i, float(m[o, i])) for n, m in w.items() for o in range(m.shape[0]) for i in range(m.shape[1])] + [(n, o, -1, float(b)) for n, v in bias.items() for o, b in enumerate(v)]
    x = rng.normal(size=(5, 6))
    h = L.rms(x)
    f = lambda n, y: y @ w[n].T + bias[n]
    pos = np.arange(5.0)
    q, k, v = L.turned(f("q", h).reshape(5, 2, 4), pos), L.turned(f("k", h).reshape(5, 1, 4), pos), f("v", h).reshape(5, 1, 4)
    a = np.zeros((5, 2, 4))
    for head in range(2):
        s = q[:, head] @ k[:, 0].T / 2
        s[np.triu_indices(5, 1)] = -np.inf
        e = np.exp(s - s.max(1, keepdims=True))
        a[:, head] = e / e.sum(1, keepdims=True) @ v[:, 0]
    m = L.rms(x + f("o", a.reshape(5, 8)))
    want = x + f("down", L.silu(f("gate", m)) * f("up", m))
    df = spark.createDataFrame([(7, p, [float(u) for u in r]) for p, r in enumerate(x)], "seq long, pos long, x array<double>")
    got = L.decoder_layer(df, spark.createDataFrame(rows, "name string, o int, i int, value double"), 2, 1).orderBy("pos").collect()
    assert np.allclose([r["y"] for r in got], want)
