"""N-gram Jaccard join by a token-group matrix: which documents share enough of their word shingles, and their components.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of word shingles. Every step below is
exact: it leaves out only pairs that cannot link, or pairs that are known to be in one component already.

1. Each text becomes the set of its shingles' 64-bit hashes, once. Kept of it: size, a digest, keys made of its minima
   under different hash orders, the tokens of its prefix, and its row of the matrix (how many of its tokens fall into each
   of COLUMNS hashed token columns). Equal sets are one node from here on.
2. Nodes with an equal key form a group. Each is compared with a few leaders of its groups; what links is contracted.
3. Sets that link share a token of their prefixes (the rarest tokens in one global order; frequent tokens come last).
   Under each token that more than one component has, nodes are put into groups of about GROUP nodes of similar size,
   large components into groups of their own. A group's row of the matrix is its token union: the most and fewest
   tokens that any member has in each column. It bounds what a query can share with any member, so only qualifying
   groups are opened, and groups of one and the same component are never paired.
4. Members of opened groups that pass the same bound one by one are compared exactly, on the whole sets.
5. Components of all links: the smallest id spreads along links, with shortcuts, until nothing changes. Up to
   SMALL_GRAPH links, counted before, are joined in one task, with the same result.

Frequent tokens are found on every 16th document (by a hash of its id); this sets the order, hence the speed, and
leaves out nothing. Sets travel only for pairs that are compared; never all pairs of a group of copies.

Defined cases: null or empty text, or text without words, has an empty set and is linked with nothing; fewer words
than a shingle make one shingle of the whole sequence; rows with a null doc_id get their size and a null component;
rows that share a doc_id belong to one component; ties go to the smallest id; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, discard, stored, unused
from millrace.operators.dedup import SMALL_GRAPH, in_one_task, smallest_labels

COLUMNS = 64
FINE_COLUMNS = 8192
GROUP = 48
#: A node has BANDS keys of BAND_ROWS minima each; nodes with an equal key are compared with LEADERS of them.
BANDS, BAND_ROWS, LEADERS = 6, 4, 3
#: How often leaders are drawn at most, and the share of the nodes (one in FEW) under which new links end it. This sets
#: what is left to the token groups, hence the speed; every pair that may link is compared in any case.
TURNS, FEW = 3, 1000
#: Groups under a token that others are paired with in one share.
SHARE = 64
#: Frequent tokens that the order knows at most. The rest are ordered by hash; no pair is lost.
HOT_TOKENS = 65_536
SAMPLE = 16
SAMPLE_LEAST = 4

#: Bytes of a word that are hashed by table, and bytes of a text that are split into words at once, about.
WORD_PLACES, AT_ONCE = 64, 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0x94D049BB133111EB)
_ORDERS = np.array([(2 * k + 1) * 0xBF58476D1CE4E5B9 % (1 << 64) | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)


def _table() -> np.ndarray:
    """A 64-bit number for every place of a word and every byte there; A-Z have those of a-z."""
    x = (np.arange(1, WORD_PLACES * 256 + 1, dtype=np.uint64) * _MIX).reshape(WORD_PLACES, 256)
    for shift, by in ((30, np.uint64(0xBF58476D1CE4E5B9)), (27, _LAST)):
        x = (x ^ (x >> np.uint64(shift))) * by
    x ^= x >> np.uint64(31)
    x[:, 65:91] = x[:, 97:123]
    return x.reshape(-1)


_PLACE_BYTE = _table()
_IN_WORD = np.array([c not in b"\t\n\v\f\r " for c in range(256)])
_SPACE = re.compile(rb"[\t\n\v\f\r ]")


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _IN_WORD[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, size = edges[::2], edges[1::2] - edges[::2]
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    at = np.arange(0, int(size.sum()) << 8, 256) - np.repeat(first << 8, size)
    long = np.flatnonzero(size > WORD_PLACES)
    if len(long):
        at = at.clip(0, (WORD_PLACES - 1) << 8)
    at += b[inside[1:-1]]
    out = np.add.reduceat(_PLACE_BYTE.take(at), first)
    for i in long:
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + size[i]].lower())
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, in order: the numbers of its places summed (words over WORD_PLACES bytes: xxhash). A-Z count as a-z."""
    if len(raw) <= AT_ONCE:
        return _hashes(raw)
    out, at = [], 0
    while at < len(raw):
        m = _SPACE.search(raw, at + AT_ONCE)
        end = m.start() if m else len(raw)
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; A-Z is lower-cased, words split at ASCII white space."""
    h = word_hashes(text.encode()) if text else np.zeros(0, np.uint64)
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)  # shorter sequences are other shingles
    for j in range(width):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[j : n - width + 1 + j]
    out ^= out >> np.uint64(29)
    out *= _LAST
    out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: the minima of the set under the band's hash orders, hashed together."""
    mixed = hashes[None, :] * _ORDERS[:, None]
    mixed ^= mixed >> np.uint64(32)
    least = mixed.min(axis=1).reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


def columns_of(hashes: np.ndarray) -> np.ndarray:
    """The set's row of the matrix: how many of its tokens fall into each column."""
    return np.bincount((hashes & np.uint64(COLUMNS - 1)).astype(np.int64), minlength=COLUMNS).clip(0, 65535).astype("<u2")


def parities_of(hashes: np.ndarray) -> list[int]:
    """256 bits: whether the set has an odd number of tokens in each of 256 columns. Bits that differ bound |A xor B| from below."""
    odd = np.bincount(((hashes >> np.uint64(16)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def fine_columns_of(hashes: np.ndarray) -> np.ndarray:
    """The same over more columns for larger sets: about two tokens a column; none for sets that COLUMNS are enough for."""
    n = len(hashes)
    if n < 2 * COLUMNS:
        return np.zeros(0, np.uint8)
    width = min(FINE_COLUMNS, 1 << (n // 2 - 1).bit_length())
    return np.bincount(((hashes >> np.uint64(8)) & np.uint64(width - 1)).astype(np.int64), minlength=width).clip(0, 255).astype(np.uint8)


def probe_length(n: int, percent: int) -> int:
    """Tokens of the prefix of a set of n: any set that links with it, not larger than it, has one of them early."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):
    """Tokens of the shorter prefix that suffices for the smaller one of two sets."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _hot(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank) of frequent tokens, at most HOT_TOKENS."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_hashes(t.as_py(), k) for t in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["tok"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counted = some.mapInArrow(run, "tok long").groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_LEAST)
    got = counted.orderBy(F.desc("n"), "tok").limit(HOT_TOKENS).collect()
    tok = np.array([r["tok"] for r in got], np.int64).view(np.uint64)
    rank = np.arange(len(tok), 0, -1)  # the most frequent last
    order = np.argsort(tok)
    return tok[order], rank[order]


def _sketches(docs: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of docs: doc_id, n, c (digest of the set), keys, prefix (int tokens), cols, fine, odd."""
    hot_tok, hot_rank = docs.sparkSession.sparkContext.broadcast(hot[0]), docs.sparkSession.sparkContext.broadcast(hot[1])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ht, hr = hot_tok.value, hot_rank.value
        for part in parts:
            n, c, keys, prefix, cols, fine, odd = [], [], [], [], [], [], []
            for t in part.column(1):
                s = shingle_hashes(t.as_py(), k)
                n.append(len(s))
                c.append(xxhash.xxh3_128_digest(s.tobytes()))
                cols.append(columns_of(s).tobytes())
                fine.append(fine_columns_of(s).tobytes())
                odd.append(parities_of(s))
                if not len(s):
                    keys.append([])
                    prefix.append([])
                    continue
                keys.append(band_keys(s))
                p = probe_length(len(s), percent)
                if len(ht):
                    at = np.searchsorted(ht, s).clip(0, len(ht) - 1)
                    rank = np.where(ht[at] == s, hr[at], 0)
                    cold = np.flatnonzero(rank == 0)[:p]
                    chosen = s[cold]
                    if len(chosen) < p:
                        warm = np.flatnonzero(rank)
                        chosen = np.concatenate([chosen, s[warm[np.lexsort((s[warm], rank[warm]))]][: p - len(chosen)]])
                else:
                    chosen = s[:p]
                prefix.append((chosen >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int32()), pa.array(c, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int32())), pa.array(cols, pa.binary()), pa.array(fine, pa.binary()), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "n", "c", "keys", "prefix", "cols", "fine", "odd"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, c binary, keys array<long>, prefix array<int>, cols binary, fine binary, odd array<long>")


def _near(na, nb, a: np.ndarray, b: np.ndarray, percent: int):
    """Whether two rows of the matrix leave it possible that their sets link: |A xor B| >= sum |a - b|."""
    apart = np.abs(a.astype(np.int32) - b.astype(np.int32)).sum(axis=-1)
    return (100 + percent) * apart <= (100 - percent) * (np.asarray(na, np.int64) + np.asarray(nb, np.int64))


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of |A xor B| by fine columns; a wider row is folded to the width of the other."""
    if not x or not y:
        return 0
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    if len(a) != len(b) and (a == 255).any() | (b == 255).any():
        return 0  # clipped counts cannot be folded
    while len(a) > len(b):
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] + b[len(b) // 2 :]
    return int(np.abs(a - b).sum())


def _labelled(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """nodes with comp: the component so far."""
    if comps is None:
        return nodes.withColumn("comp", F.col("doc_id"))
    known = comps.select(F.col("v").alias("known"), "comp")
    return nodes.join(broadcast_if_small(known, known.count()), F.col("doc_id") == F.col("known"), "left").drop("known").withColumn("comp", F.coalesce("comp", "doc_id"))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b) to those whose rows of the matrix leave it possible that they link. nodes have comp."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            va, vb = (_rows(part.column(x)) for x in ("va", "vb"))
            na, nb = part.column("na").to_numpy().astype(np.int64), part.column("nb").to_numpy().astype(np.int64)
            ok = _near(na, nb, va, vb, percent)
            fa, fb = part.column("fa"), part.column("fb")
            for i in np.flatnonzero(ok):
                ok[i] = (100 + percent) * _apart(fa[i].as_py(), fb[i].as_py()) <= (100 - percent) * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays([part.column(x).filter(pa.array(ok)) for x in ("a", "b")], names=["a", "b"])

    side = lambda x: nodes.select(F.col("doc_id").alias(x), *[F.col(c).alias(d + x) for c, d in (("n", "n"), ("comp", "c"), ("odd", "o"), ("cols", "v"), ("fine", "f"))])
    apart = sum((F.bit_count(F.get("oa", F.lit(k)).bitwiseXOR(F.get("ob", F.lit(k)))) for k in range(4)), F.lit(0))
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("ca") != F.col("cb")) & sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))))
    return full.select("a", "b", "na", "nb", "va", "vb", "fa", "fb").mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Of candidate pairs (a, b) those whose whole sets link. Written to the shared folder."""
    close = stored(_possible(pairs, nodes, percent), f"{name}-close")
    n = close.count()
    ids = broadcast_if_small(close.select(F.col("a").alias("id")).union(close.select("b")), 2 * n)
    some = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = [shingle_hashes(t.as_py(), k).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "c", "s"])

    have = stored(some.mapInArrow(sets, "id long, c binary, s binary").dropDuplicates(["id", "c"]), f"{name}-sets")
    full = have.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(broadcast_if_small(close, n), "a").join(have.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = [], []
            for i, j, x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                sx, sy = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                if 100 * both >= percent * (len(sx) + len(sy) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = stored(full.mapInArrow(compare, "a long, b long"), f"{name}-links")
    discard(close, have)
    return out


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(v, comp): the smallest id reachable along links (a, b), for every id that has a link.

    With steps, only so many: ids of one comp are of one component then, but not the other way round. The links are read
    twice at least, so they should be stored; repeated links and those of an id with itself change nothing.
    """
    links = links.select("a", "b").where("a <> b")
    if links.count() <= SMALL_GRAPH:  # one task joins few links, with the same result
        return stored(in_one_task(links, smallest_labels, "v long, comp long"), "label")
    given = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "given")
    both = stored(given.union(given.select("v", "u")), "edges")
    discard(given)
    label, step = stored(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("comp")), "label"), 0
    while steps is None or step < steps:
        around = both.join(label.toDF("u", "lu"), "u").groupBy("v").agg(F.min("lu").alias("m"))
        lower = label.join(around, "v").select("v", "comp", F.least("comp", "m").alias("new"))
        short = lower.join(label.toDF("w", "lw"), F.col("new") == F.col("w"), "left").select("v", "comp", F.least("new", F.coalesce("lw", "new")).alias("new"))
        done, step = stored(short, "label"), step + 1
        same = steps is None and done.where("comp <> new").limit(1).count() == 0
        discard(label)
        label = done.select("v", F.col("new").alias("comp"))
        label._millrace_path = done._millrace_path
        if same:
            break
    discard(both)
    return label


def _starred(nodes: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs (a, b) of each node and LEADERS ids, drawn by hash, of those that have an equal key. nodes have comp.

    Several leaders, since copies that have each changed need not be close enough to a single one of them; in later
    turns others, under keys that more than one component has by then.
    """
    each = nodes.select("doc_id", "comp", F.explode("keys").alias("key"))
    # the smallest id after its bits are flipped by a hash of the key: a draw that a plain minimum makes
    flips = [F.xxhash64("key", F.lit(turn * LEADERS + r)) for r in range(LEADERS)]
    drawn = [F.min(F.col("doc_id").bitwiseXOR(f)).alias(f"m{r}") for r, f in enumerate(flips)]
    first = each.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *drawn).where("x <> y")
    first = first.select("key", F.array_distinct(F.array(*[F.col(f"m{r}").bitwiseXOR(f) for r, f in enumerate(flips)])).alias("b"))
    pairs = each.join(first, "key").select(F.col("doc_id").alias("a"), F.explode("b").alias("b")).where("a <> b")
    # an id has BANDS * LEADERS rows at most: dealt by a once, for the distinct pairs and for what is joined by a
    return pairs.repartition("a").distinct()


def _rows(cols: pa.Array) -> np.ndarray:
    """Rows of the matrix out of a binary column."""
    return np.frombuffer(b"".join(cols.to_pylist()), "<u2").reshape(-1, COLUMNS)


def _members(lists: pa.Array) -> tuple[np.ndarray, dict]:
    """(where each group starts, and the end; the members' fields as arrays) of a column of groups."""
    flat = lists.flatten()
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    out = {x: fields[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("doc_id", "comp", "n", "pos")}
    out["v"] = _rows(fields["cols"])
    if "fine" in fields:
        out["fine"] = fields["fine"]
    return np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64), out


def _maybe(m: dict, i: np.ndarray, w: dict, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members i of m and j of w, that share a token, may link and are not known to be of one component."""
    na, nb, at, bt = m["n"][i], w["n"][j], m["pos"][i], w["pos"][j]
    ok = (m["comp"][i] != w["comp"][j]) & (100 * nb >= percent * na) & (100 * na >= percent * nb)
    # under the first token that two sets share, what stands before it in either is not shared
    ok &= (100 + percent) * (at + bt) <= (100 - percent) * (na + nb)
    # the smaller set has the token in its shorter prefix; equal sizes allow either
    return ok & ((nb >= na) | (bt < index_length(nb, percent))) & ((nb <= na) | (at < index_length(na, percent)))


def _within(at: np.ndarray, m: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among the members of each group."""
    group, n = np.repeat(np.arange(len(at) - 1), np.diff(at)), int(at[-1])
    out = []
    for apart in range(1, int(np.diff(at).max(initial=0))):
        i = np.flatnonzero(group[apart:] == group[: n - apart])
        i = i[_maybe(m, i, m, i + apart, percent)]
        i = i[_near(m["n"][i], m["n"][i + apart], m["v"][i], m["v"][i + apart], percent)]
        out.append((m["doc_id"][i], m["doc_id"][i + apart]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _open(m: dict, i: np.ndarray, w: dict, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Candidate pairs of queries (i of m) and members (j of w) of a group, if the group's token union lets the query in."""
    v, u = m["v"][i].astype(np.int32), w["v"][j].astype(np.int32)
    most, least, largest = u.max(axis=0), u.min(axis=0), int(w["n"][j].max())
    # the union's bound: no member can be closer to the query than this
    apart = (np.maximum(v - most, 0) + np.maximum(least - v, 0)).sum(axis=1)
    out = []
    for q in i[(100 + percent) * apart <= (100 - percent) * (m["n"][i] + largest)]:
        k = j[_maybe(m, np.full(len(j), q), w, j, percent)]
        k = k[_near(m["n"][q], w["n"][k], m["v"][q][None, :], w["v"][k], percent)]
        fine = m["fine"][q].as_py() if len(k) else b""
        out += [(int(m["doc_id"][q]), int(w["doc_id"][x])) for x in k if (100 + percent) * _apart(fine, w["fine"][x].as_py()) <= (100 - percent) * (m["n"][q] + w["n"][x])]
    return out


def _grouped(nodes: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate pairs (a, b) of different components, out of the groups under each token that qualify. nodes have comp.

    The second value: the tables that the pairs are read from.
    """
    multi = nodes.select("comp", F.explode("prefix").alias("tok")).groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).where("x <> y").select("tok", "k")
    toks = nodes.select("doc_id", F.posexplode("prefix").alias("pos", "tok")).join(multi, "tok")
    rows = toks.join(nodes.select("doc_id", "comp", "n", "cols"), "doc_id")
    rows = stored(rows.select("tok", "k", F.struct("doc_id", "comp", "n", "pos", "cols").alias("m")), "matrix")

    def within(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = _within(*_members(part.column(0)), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # few rows under a token: they are one group, compared within itself
    small = rows.where(F.col("k") <= GROUP).groupBy("tok").agg(F.collect_list("m").alias("ms")).select("ms").mapInArrow(within, "a long, b long")

    # many: groups by size class, the large components in groups of their own, all of about GROUP rows; groups of the
    # same and of neighbouring classes are paired, but for those of one and the same component
    many = rows.where(F.col("k") > GROUP).withColumn("class", F.floor(F.log(F.col("m.n").cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("int")).withColumn("comp", F.col("m.comp"))
    counts = stored(many.groupBy("tok", "class", "comp").agg(F.count("*").alias("own")), "counts")
    large = counts.where(F.col("own") > GROUP)
    mixed = counts.where(F.col("own") <= GROUP).groupBy("tok", "class").agg(F.sum("own").alias("mixed"))
    sized = many.join(broadcast_if_small(large, large.count()), ["tok", "class", "comp"], "left").join(broadcast_if_small(mixed, counts.count()), ["tok", "class"], "left")
    # here the bound on members is taken over the fine columns too: there are few such rows, but many pairs
    fine = nodes.select(F.col("doc_id").alias("owner"), "fine")
    sized = sized.join(fine, F.col("m.doc_id") == F.col("owner")).withColumn("m", F.struct("m.*", "fine"))
    chunk = F.pmod(F.xxhash64("m.doc_id"), F.ceil(F.coalesce("own", "mixed") / F.lit(GROUP)).cast("long"))
    side = F.when(F.col("own").isNull(), F.lit(-(2**62))).otherwise(F.col("comp"))
    groups = stored(
        sized.groupBy("tok", F.struct("class", side.alias("side"), chunk.alias("chunk")).alias("g")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("k").alias("k"), F.collect_list("m").alias("m")), "groups"
    )
    # the groups under a token are dealt by class and, where there are very many, to further shares of SHARE groups
    shares = F.greatest(F.lit(1), F.ceil(F.col("k") / (GROUP * SHARE))).cast("long")
    a = groups.select("tok", F.col("g").alias("ga"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("m").alias("ma"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    a = a.withColumn("class", F.explode(F.array(F.col("ga.class"), F.col("ga.class") + 1)))
    b = groups.select("tok", F.col("g").alias("gb"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("m").alias("mb"), F.pmod(F.xxhash64("g"), shares).alias("share"), F.col("g.class").alias("class"))
    one = (F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")) & (F.col("la") == F.col("lb"))
    met = a.join(b, ["tok", "class", "share"]).where((F.col("ga") <= F.col("gb")) & ~one)

    def across(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (at, m), (bt, w) = _members(part.column(1)), _members(part.column(2))
            out: list[tuple[int, int]] = []
            for k, same in enumerate(part.column(0).to_pylist()):
                i, j = np.arange(at[k], at[k + 1]), np.arange(bt[k], bt[k + 1])
                found = _open(m, i, w, j, percent)
                out += [p for p in found if p[0] < p[1]] if same else found
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return small.union(met.select((F.col("ga") == F.col("gb")).alias("same"), "ma", "mb").mapInArrow(across, "a long, b long")), [rows, counts, groups]


def join_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    sketch = stored(_sketches(docs, k, percent, _hot(docs, k)), "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    once = full.groupBy("c").agg(F.min("doc_id").alias("doc_id"), *[F.first(x).alias(x) for x in ("n", "keys", "prefix", "cols", "fine", "odd")])
    nodes = stored(once, "nodes")
    n_nodes, comps, turns = nodes.count(), None, []
    for turn in range(TURNS):
        now = _labelled(nodes, comps)
        found = _links(docs, _starred(now, turn), now, k, percent, "star")
        turns.append(found)
        star, before = reduce(DataFrame.union, turns), comps
        comps = components(star, steps=2)
        if before is not None:
            discard(before)
        if found.count() * FEW < n_nodes:
            break
    now = stored(_labelled(nodes, comps), "labelled")
    pairs, read = _grouped(now, percent)
    # an id may have many pairs here: made distinct by both ids, and a hot a is left to the join to split
    more = _links(docs, pairs.where("a <> b").distinct(), now, k, percent, "group")
    discard(comps, now, *read)
    # equal sets, and rows that share an id, are links too
    copies = full.select("doc_id", "c").join(nodes.select("c", F.col("doc_id").alias("first")), "c").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    same = stored(copies, "copies")
    final = components(star.union(more).union(same)).toDF("id", "component_id")
    discard(nodes, same, more, *turns)
    out = sketch.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(broadcast_if_small(final, final.count()), F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; rows that repeat a kept doc_id stay."""
    name = unused(docs, "dropped")
    drop = join_components(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs["doc_id"] == drop[name], "left_anti")
