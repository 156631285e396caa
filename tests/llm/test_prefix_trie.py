"""The trie against a plain dictionary of beginnings: stitched partitions, rounds of segments, waiting rows, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import prefix_trie as P  # noqa: E402


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(own, every=5, most=9):
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % every, [])[:h] + v[h:]
    return out


def plainly(seqs):
    members = defaultdict(list)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    rows, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in kids[k]) or 1
        saved = sum(sums[x][1] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        sums[k] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        rows.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "k", "g") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string, g string").repartition(parts)


def have(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def some(seed, n, deep, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if words > 2 else "user", rng.choice("aé漢bcdefgh"[:words]) * rng.choice([1, 1, 3])) for c in range(n) for t in range(rng.randrange(deep))]


@pytest.mark.parametrize("seed, n, deep, words, how", [(0, 120, 6, 2, {}), (1, 60, 14, 1, {"first": 2, "most": 4}), (2, 150, 9, 3, {"first": 1, "most": 2, "pending": 3, "block": 4}), (3, 200, 4, 2, {"pending": 1, "block": 1})])
def test_trie(spark, seed, n, deep, words, how):
    rows = some(seed, n, deep, words)
    turns = table(spark, rows)
    assert have(P.trie(P.sequences(turns), **how)) == plainly(ordered(rows))
    assert have(P.trie(P.rebuilt(turns), **how)) == plainly(rebuilt(ordered(rows)))


def test_copies_and_a_hot_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(5)] + [(1000 + c, t, "user", f"long {t}") for c in range(2) for t in range(150)] + [(2000, t, "user", f"long {t if t < 140 else -t}") for t in range(400)]
    turns = table(spark, rows)
    assert have(P.trie(P.sequences(turns), block=64)) == plainly(ordered(rows))
    assert have(P.trie(P.rebuilt(turns))) == plainly(rebuilt(ordered(rows)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "", ""), (1, 2, "user", "x" * 1_000_000), (2, 1, "a", "tie"), (2, 1, "a", "tie"), (2, 1, "A", "tie"), (-7, 1, "user", "below zero"), (-10, 1, "user", "base"), (-(2**63), 1, "u", "least"), (2**63 - 1, 1, "u", "most"), (9, 1, "", "role: text"), (9, 2, "role", ": text")]
    turns = table(spark, rows)
    assert have(P.trie(P.sequences(turns))) == plainly(ordered(rows))
    assert have(P.trie(P.rebuilt(turns.where("conv_id > -9000000000")))) == plainly(rebuilt(ordered([r for r in rows if r[0] is None or r[0] > -9_000_000_000])))
    assert P.trie(P.rebuilt(turns)).count() > 0
    assert have(P.trie(P.rebuilt(turns.where("false")))) == []


@pytest.mark.parametrize("seed", range(60))
def test_sweep_and_stitch(seed):
    """Any split of the sorted rows into partitions gives the same nodes."""
    rng = random.Random(seed)
    seqs = {c: [rng.choice("ab") for _ in range(rng.randrange(5))] for c in range(rng.randrange(1, 25))}
    digest = {w: hashlib.sha256(w.encode()).digest()[:16] for w in "ab"}
    rows = sorted((b"\0" * 16 + b"".join(digest[w] for w in v), c, [1] * len(v), True, 0, 0, 0) for c, v in seqs.items())
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
    names, nodes, waits, refs, pieces, edges, ids = P.OUT.names, [], [], {}, defaultdict(list), {}, defaultdict(list)
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        for record in P.sweep(iter(rows[a:b]), part, rng.choice([0, 2, 99]), rng.choice([1, 99])):
            r = dict(zip(names, record, strict=True))
            if r["kind"] == "edge":
                edges[part] = r["first_key"], r["last_key"]
            elif r["kind"] == "piece":
                x = P.Node(r["depth"], r["bytes"], r["ends"])
                x.add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
                x.refs = [(part, r["ref"])]
                pieces[part].append(x)
            elif r["kind"] == "ids":
                ids[part, r["parent_ref"]].append(r["ends"])
            elif r["kind"] == "ref":
                refs[part, r["ref"]] = r["conv_id"]
            else:
                (nodes if r["kind"] == "node" else waits).append(r)
    have = []
    for depth, conv, parent, n, children, leaves, saved, of in P.stitch((*edges[p], pieces[p]) for p in sorted(edges)):
        refs |= dict.fromkeys(of, conv)
        ends = ",".join(x for r in of for x in ids[r])
        have.append((conv, depth - 1, parent, n, children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    for r in nodes + waits:
        parent = r["parent_conv_id"] if r["kind"] == "node" else refs[r["part"], r["parent_ref"]]
        have.append((r["conv_id"], r["depth"] - 1, parent, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"]))
    assert sorted(have, key=repr) == plainly({c: [("", w) for w in v] for c, v in seqs.items()})
