"""The trie of all conversations' beginnings: every distinct sequence of first turns, and how many conversations share it.

Turns are numbered by one range sort of all rows; a turn is known by 128 bits of the SHA-256 digest of its role and text.
The digests of a conversation's first turns, one after the other, are its sort key. All conversations are range-sorted
by key and conv_id: those that share a beginning are neighbours, and the turns that adjacent keys have in common (their
LCP) are the depths that stay open from one to the next. A sweep over each sorted partition keeps a stack of the open
nodes; a node closes, with all its counts, where the LCP falls below its depth. The nodes that the first or the last
conversation of a partition goes through may reach beyond it: of these only pieces are known, at most the turns of two
keys a partition. The pieces are stitched in partition order by the same rule, from the LCP of the keys on both sides
of each boundary. Nodes of a third of all conversations are so put together from pieces of a third of the partitions.

A key holds a segment of at most FIRST turns. Conversations that agree on all of it with others and go on are taken up
again in the next round, grouped by what they share, with segments that double up to MOST turns; what their subtrees sum
up to is then handed up, round by round. A conversation that goes on alone is a chain, and its nodes are simply listed.
Thus neither a row, a stack nor a task grows with the length of a conversation or with the size of a group.

The parent's conv_id of a node is known when the parent closes. Until then up to PENDING rows wait; beyond, they are
written with the parent's number, and get its conv_id by a join with the few parents that had rows waiting. The ids of
conversations that end in a node of several pieces are written in blocks and hashed in order, one block at a time.

Defined cases: null role or text is empty; turns that tie are ordered by role and text; repeated turns are kept; rows
without conv_id belong to no conversation and have no part in the trie; a conversation of which no turn is left ends in
the root; an empty table has no node; other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import broadcast_if_small, discard, stored

#: Turns of the first segment, and of the longest.
FIRST, MOST = 32, 1024
#: Rows that wait for their parents at once in a task, and bytes of ids that are held for a node.
PENDING, BLOCK = 50_000, 1 << 16
#: Nodes of a chain that one row stands for until they are listed.
LINKS = 10_000
#: Bytes of a turn's digest.
WIDE = 16
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass
class Sequences:
    """rows: (conv_id, pos, digest, bytes), pos from 0 without gaps. counts: (conv_id, n), turnless conversations too."""

    rows: DataFrame
    counts: DataFrame


# -- turns in order ---------------------------------------------------------------------------------------------------


def _ranged(turns: DataFrame) -> DataFrame:
    """(conv_id, part, id, digest, bytes): ids rise along the order of turns. Written to the shared folder, without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    order = ["conv_id", F.col("turn").asc_nulls_first()]  # a hot conversation is dealt to several partitions
    t = t.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    t = t.select("conv_id", F.unhex(F.substring(digest, 1, 2 * WIDE)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id"))
    return stored(t.withColumn("part", F.shiftright("id", 33)), "trie-turns")


def _starts(ranged: DataFrame) -> DataFrame:
    """(conv_id, part, first, k, offset): where a conversation's turns begin in a partition, and how many stand before it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    return own.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0)))


def _placed(ranged: DataFrame, starts: DataFrame, pos: Column) -> DataFrame:
    """ranged with pos. A hot conversation is joined partition by partition."""
    at = starts.withColumnsRenamed({"conv_id": "c2", "part": "p2"})
    return ranged.join(at, (F.col("conv_id") == F.col("c2")) & (F.col("part") == F.col("p2"))).withColumn("pos", pos).drop("c2", "p2")


def sequences(turns: DataFrame) -> Sequences:
    """The conversations as they are."""
    ranged = _ranged(turns)
    starts = _starts(ranged)
    pos = F.col("id") - F.col("first") + F.col("offset")
    rows = stored(_placed(ranged, starts, pos).select("conv_id", "pos", "digest", "bytes"), "trie-rows")
    counts = stored(starts.groupBy("conv_id").agg(F.sum("k").alias("n")), "trie-counts")
    discard(ranged)
    return Sequences(rows, counts)


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> Sequences:
    """Every conversation c with its first h turns replaced by those of conversation c - c % every; h = crc32(c) % most."""
    ranged = _ranged(turns)
    starts = stored(_starts(ranged), "trie-starts")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.try_subtract(F.col("conv_id"), F.pmod("conv_id", F.lit(every)))
    own = starts.groupBy("conv_id").agg(F.sum("k").alias("n")).withColumns({"h": h, "base": base})
    lengths = own.select(F.col("conv_id").alias("b2"), F.col("n").alias("nb"))
    given = F.least("h", F.coalesce("nb", F.lit(0)))
    convs = stored(own.join(lengths, F.col("base") == F.col("b2"), "left").select("conv_id", "n", "h", "base", given.alias("given")), "trie-convs")
    known = starts.join(convs.select(F.col("conv_id").alias("c3"), "h", "given"), F.col("conv_id") == F.col("c3")).drop("c3")
    pos = F.col("id") - F.col("first") + F.col("offset")
    placed = stored(_placed(ranged, known, pos).select("conv_id", "pos", "digest", "bytes", "h", "given"), "trie-placed")
    kept = placed.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "digest", "bytes")
    heads = placed.where((F.col("pos") < most) & (F.pmod("conv_id", F.lit(every)) == 0)).select(F.col("conv_id").alias("b2"), "pos", "digest", "bytes")
    taken = convs.select("conv_id", "base", F.col("given").alias("g")).join(heads, (F.col("base") == F.col("b2")) & (F.col("pos") < F.col("g"))).select("conv_id", "pos", "digest", "bytes")
    rows = stored(kept.unionByName(taken), "trie-rows")
    counts = stored(convs.select("conv_id", (F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n")), "trie-counts")
    discard(ranged, starts, convs, placed)
    return Sequences(rows, counts)


# -- the sweep --------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Digests that two keys have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDE : mid * WIDE] == b[low * WIDE : mid * WIDE]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """An open node. It counts conversations, children, leaves and saved bytes of what has closed below it so far."""

    __slots__ = ("bytes", "children", "depth", "digest", "held", "ids", "leaves", "least", "left", "n", "ref", "refs", "saved", "waiting")

    def __init__(self, depth: int, size: int, left: bool = False):
        self.depth, self.bytes, self.left = depth, size, left
        self.n = self.children = self.leaves = self.saved = self.held = 0
        self.least: int | None = None
        self.digest, self.ids, self.waiting, self.ref, self.refs = None, [], [], None, []

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def closed(self) -> tuple[int, int]:
        """(leaves, saved) of the whole subtree."""
        return self.leaves if self.children else 1, self.saved + (self.n - 1) * self.bytes


OUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # node, wait (for its parent), ref (a parent), piece, ids, edge
        T.StructField("part", T.LongType()),
        T.StructField("ref", T.LongType()),  # of a piece or a parent, within the partition; a block's number at ids
        T.StructField("depth", T.LongType()),
        T.StructField("conv_id", T.LongType()),
        T.StructField("parent_conv_id", T.LongType()),
        T.StructField("n_convs", T.LongType()),
        T.StructField("n_children", T.LongType()),
        T.StructField("n_leaves", T.LongType()),
        T.StructField("saved_tokens", T.LongType()),
        T.StructField("ends", T.StringType()),  # digest; ids at ids; side at piece
        T.StructField("bytes", T.LongType()),
        T.StructField("parent_ref", T.LongType()),
        T.StructField("first_key", T.BinaryType()),
        T.StructField("last_key", T.BinaryType()),
    ]
)


def _record(kind: str, part: int, **have) -> tuple:
    return tuple({"kind": kind, "part": part, **have}.get(c) for c in OUT.names)


def sweep(rows: Iterator[tuple], part: int, pending: int = PENDING, block: int = BLOCK, grouped: bool = False) -> Iterator[tuple]:
    """Records of OUT from rows (key, conv_id, bytes of each turn, ends, children, leaves, saved) in order of key and conv_id.

    The key's first digest stands for the group; depth 1 is the group's node, which has no parent here. grouped: that
    digest is the node's conv_id, which need not go on itself. children, leaves and saved: of what goes on below the end
    of the key.
    """
    stack: list[Node] = []
    out: list[tuple] = []
    first = last = None
    refs = waiting = blocks = 0

    def numbered(x: Node) -> int:
        nonlocal refs
        if x.ref is None:
            x.ref, refs = refs, refs + 1
        return x.ref

    def written(x: Node) -> None:
        """The held ids of a node become a block."""
        nonlocal blocks
        if x.ids:
            out.append(_record("ids", part, parent_ref=numbered(x), ref=blocks, ends=",".join(map(str, x.ids))))
            blocks += 1
            x.ids, x.held = [], 0

    def released(x: Node) -> None:
        """What waits for a node is written with the node's number."""
        nonlocal waiting
        if x.waiting:
            ref = numbered(x)
            out.extend(_record("wait", part, parent_ref=ref, **row) for row in x.waiting)
            waiting -= len(x.waiting)
            x.waiting = []

    def piece(x: Node, side: str) -> None:
        written(x)
        released(x)
        out.append(_record("piece", part, ref=numbered(x), depth=x.depth, conv_id=x.least, n_convs=x.n, n_children=x.children, n_leaves=x.leaves, saved_tokens=x.saved, ends=side, bytes=x.bytes))

    def close(x: Node) -> None:
        nonlocal waiting
        if x.left:
            piece(x, "l")
            return
        leaves, saved = x.closed()
        up = stack[-1]
        up.add(x.n, x.least, 1, leaves, saved)
        out.extend(_record("node", part, parent_conv_id=x.least, **row) for row in x.waiting)
        waiting -= len(x.waiting)
        if x.ref is not None:
            out.append(_record("ref", part, ref=x.ref, conv_id=x.least))
        row = {"depth": x.depth, "conv_id": x.least, "n_convs": x.n, "n_children": x.children, "n_leaves": leaves, "saved_tokens": saved, "ends": x.digest.hexdigest() if x.digest else NOTHING}
        if x.depth == 1:
            out.append(_record("node", part, **row))
            return
        up.waiting.append(row)
        waiting += 1
        if waiting > pending:
            for y in stack:
                released(y)

    for key, conv, sizes, ends, children, leaves, saved in rows:
        deep = len(key) // WIDE
        shared = -1 if first is None else common(last, key)
        while len(stack) - 1 > shared:
            close(stack.pop())
        while len(stack) <= deep:
            d = len(stack)
            stack.append(Node(d, sizes[d - 2] if d > 1 else 0, first is None))
            if d == 1 and grouped:
                stack[-1].least = int.from_bytes(key[WIDE - 8 : WIDE], signed=True)
        top = stack[-1]
        top.add(1, conv, children, leaves, saved)
        if ends:
            text = str(conv)
            if top.digest is None:
                top.digest = hashlib.sha256(text.encode())
            else:
                top.digest.update(f",{text}".encode())
            top.ids.append(conv)
            top.held += len(text) + 1
            if top.held > block:
                written(top)
        first, last = key if first is None else first, key
        if out:
            yield from out
            out.clear()
    while stack:
        x = stack.pop()
        piece(x, "b" if x.left else "r")
    if first is not None:
        out.append(_record("edge", part, first_key=first, last_key=last))
    yield from out


def stitch(parts: Iterator[tuple[bytes, bytes, list[Node]]]) -> Iterator[tuple]:
    """Nodes (depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, refs) from the pieces of all partitions.

    parts: (first key, last key, pieces) in order; a piece's `left` is its side. What is held are the pieces, never rows.
    """
    stack: list[Node] = []
    out: list[tuple] = []
    last = None

    def close(x: Node) -> None:
        leaves, saved = x.closed()
        if stack:
            stack[-1].add(x.n, x.least, 1, leaves, saved)
            stack[-1].waiting.append((x.depth, x.least, x.n, x.children, leaves, saved, x.refs))
        out.extend((depth, least, x.least if x.depth else None, *rest) for depth, least, *rest in x.waiting)

    def put(x: Node) -> None:
        if x.depth < len(stack):
            stack[x.depth].add(x.n, x.least, x.children, x.leaves, x.saved)
            stack[x.depth].refs += x.refs
        else:
            stack.append(x)

    for first_key, last_key, pieces in parts:
        shared = -1 if last is None else common(last, first_key)
        while len(stack) - 1 > shared:
            close(stack.pop())
        for x in sorted((x for x in pieces if x.left in "lb"), key=lambda x: x.depth):
            put(x)
        through = sum(x.left == "b" for x in pieces)
        while len(stack) > through:
            close(stack.pop())
        for x in sorted((x for x in pieces if x.left == "r"), key=lambda x: x.depth):
            put(x)
        last = last_key
        yield from out
        out.clear()
    while stack:
        close(stack.pop())
    yield from out


STITCHED = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, refs array<struct<part: long, ref: long>>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _swept(rows: DataFrame, pending: int, block: int, grouped: bool) -> DataFrame:
    """OUT of all partitions of rows (key, conv_id, sizes, ends, children, leaves, saved). Written to the shared folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()

        def each() -> Iterator[tuple]:
            for f in frames:
                for key, conv, sizes, ends, *below in zip(*(f[c].tolist() for c in ("key", "conv_id", "sizes", "ends", "children", "leaves", "saved")), strict=True):
                    yield (bytes(key), conv, sizes.tolist(), ends, *below)

        held: list[tuple] = []
        for record in sweep(each(), part, pending, block, grouped):
            held.append(record)
            if len(held) >= 20_000:
                yield _frame(held)
                held = []
        if held:
            yield _frame(held)

    ordered = rows.select("key", "conv_id", "sizes", "ends", "children", "leaves", "saved").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return stored(ordered.mapInPandas(run, OUT), "trie-swept")


def _frame(records: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=OUT.names, dtype="object")
    for field in OUT.fields:
        if isinstance(field.dataType, T.LongType):
            out[field.name] = out[field.name].astype("Int64")
    return out


def _stitched(swept: DataFrame) -> DataFrame:
    """STITCHED from the pieces, which are a few keys a partition. Written to the shared folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[int, list[Node]] = {}
        edges: dict[int, tuple[bytes, bytes]] = {}
        for f in frames:
            for r in f.itertuples(index=False):
                if r.kind == "edge":
                    edges[int(r.part)] = bytes(r.first_key), bytes(r.last_key)
                    continue
                x = Node(int(r.depth), int(r.bytes), r.ends)
                x.add(int(r.n_convs), None if pd.isna(r.conv_id) else int(r.conv_id), int(r.n_children), int(r.n_leaves), int(r.saved_tokens))
                x.refs = [{"part": int(r.part), "ref": int(r.ref)}]
                pieces.setdefault(int(r.part), []).append(x)
        nodes = list(stitch((*edges[p], pieces[p]) for p in sorted(edges)))
        if nodes:
            out = pd.DataFrame(nodes, columns=["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "refs"], dtype="object")
            for c in out.columns[:-1]:
                out[c] = out[c].astype("Int64")
            yield out

    return stored(swept.where("kind in ('piece', 'edge')").repartition(1).mapInPandas(run, STITCHED), "trie-stitched")


def _hashed(blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, ends): the digest of a node's blocks, joined by commas in their order, one block at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node = digest = None
        for f in frames:
            done = []
            for conv, depth, text in zip(f["conv_id"], f["depth"], f["ids"], strict=True):
                if node == (conv, depth):
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(text.encode())
            yield pd.DataFrame(done, columns=["conv_id", "depth", "ends"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=["conv_id", "depth", "ends"])

    dealt = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "ref")
    return dealt.select("conv_id", "depth", "ids").mapInPandas(run, "conv_id long, depth long, ends string")


def _nodes(rows: DataFrame, pending: int, block: int, grouped: bool) -> DataFrame:
    """NODE and ends of all nodes of the rows' groups. Depth 1 is a group's own node. Written to the shared folder."""
    swept = _swept(rows, pending, block, grouped)
    whole = _stitched(swept)
    at = whole.select("conv_id", "depth", F.explode("refs").alias("r")).select("conv_id", "depth", F.col("r.part").alias("p2"), F.col("r.ref").alias("r2"))
    ends = _hashed(swept.where("kind = 'ids'").select("part", "ref", "parent_ref", F.col("ends").alias("ids")).join(F.broadcast(at), (F.col("part") == F.col("p2")) & (F.col("parent_ref") == F.col("r2"))))
    ends = ends.withColumnsRenamed({"conv_id": "c2", "depth": "d2"})
    joined = whole.join(ends, (F.col("conv_id") == F.col("c2")) & (F.col("depth") == F.col("d2")), "left").select(*NODE, F.coalesce("ends", F.lit(NOTHING)).alias("ends"))
    parents = at.select("p2", "r2", F.col("conv_id").alias("parent")).unionByName(swept.where("kind = 'ref'").select(F.col("part").alias("p2"), F.col("ref").alias("r2"), F.col("conv_id").alias("parent")))
    wait = swept.where("kind = 'wait'").drop("parent_conv_id").join(broadcast_if_small(parents, parents.count()), (F.col("part") == F.col("p2")) & (F.col("parent_ref") == F.col("r2")))
    wait = wait.withColumnRenamed("parent", "parent_conv_id").select(*NODE, "ends")
    out = stored(swept.where("kind = 'node'").select(*NODE, "ends").unionByName(wait).unionByName(joined.where("depth > 0")), "trie-nodes")
    discard(swept, whole)
    return out


# -- rounds -----------------------------------------------------------------------------------------------------------


def bounds(first: int = FIRST, most: int = MOST) -> Callable[[int], int]:
    """The turns before segment k: segments double from first to most turns."""

    def before(k: int) -> int:
        total, width = 0, first
        for _ in range(k):
            total, width = total + width, min(2 * width, most)
        return total

    return before


def _keyed(seqs: Sequences, groups: DataFrame, low: int, high: int) -> DataFrame:
    """(conv_id, key, sizes, n, more) of the groups' conversations: their turns from low on, below high."""
    turn = F.struct("pos", "digest", "bytes")
    inside = seqs.rows.where((F.col("pos") >= low) & (F.col("pos") < high))
    held = inside.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumnRenamed("conv_id", "c2")  # at most high - low
    both = groups.join(held, F.col("conv_id") == F.col("c2"), "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<pos: bigint, digest: binary, bytes: bigint>>")))
    key = F.unhex(F.concat(F.lpad(F.hex("g"), 2 * WIDE, "0"), F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")))
    return both.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"), "n", (F.col("n") > high).alias("more"))


def _chains(alone: DataFrame, start: int) -> DataFrame:
    """The nodes below depth start of conversations (conv_id, n) that go on alone; g: the conv_id of their node at start."""
    links = alone.select("conv_id", "n", "g", F.explode(F.sequence(F.lit(start + 1).cast("long"), F.col("n"), F.lit(LINKS).cast("long"))).alias("a")).repartition("conv_id", "a")
    each = links.select("conv_id", "n", "g", F.explode(F.sequence(F.col("a"), F.least(F.col("n"), F.col("a") + (LINKS - 1)))).alias("depth"))
    goes, one = F.col("depth") < F.col("n"), F.lit(1).cast("long")
    ends = F.when(goes, F.lit(NOTHING)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256))
    return each.select("conv_id", "depth", F.when(F.col("depth") == start + 1, F.col("g")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(goes, one).otherwise(0).alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends"))


def trie(seqs: Sequences, first: int = FIRST, most: int = MOST, pending: int = PENDING, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is the first `depth` turns of conversation conv_id, its smallest member.
    """
    before = bounds(first, most)
    groups = seqs.counts.withColumn("g", F.lit(0).cast("long"))
    rounds: list[tuple[DataFrame, DataFrame, bool]] = []  # keyed rows, who of them goes on, whether any with others
    while True:
        k = len(rounds)
        rows = stored(_keyed(seqs, groups, before(k), before(k + 1)), "trie-keys")
        tops = rows.where(F.size("sizes") == before(k + 1) - before(k)).groupBy("key").agg(F.count_if("more").alias("k"), F.min("conv_id").alias("g")).where("k > 0").withColumnRenamed("key", "k2")
        on = stored(rows.where("more").join(tops, F.col("key") == F.col("k2")).select("conv_id", "n", "g", "k"), "trie-going")
        together = on.where("k > 1").limit(1).count() > 0
        rounds.append((rows, on, together))
        if not together:
            break
        groups = on.where("k > 1").select("conv_id", "n", "g")
    found: list[DataFrame] = []
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        rows, on, together = rounds[k]
        zero, single = F.lit(0).cast("long"), F.col("more").cast("long")
        if together:  # what a group's node has below it is added once, by the conversation that the node is named after
            held = on.where("k > 1").select(F.col("conv_id").alias("c2"))
            sums = below.select(F.col("conv_id").alias("c3"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            single = (F.col("more") & F.col("c2").isNull()).cast("long")
            rows = rows.join(held, F.col("conv_id") == F.col("c2"), "left").join(sums, F.col("conv_id") == F.col("c3"), "left")
            rows = rows.withColumns({"children": F.coalesce("children", single), "leaves": F.coalesce("leaves", single), "saved": F.coalesce("saved", zero)})
        else:
            rows = rows.withColumns({"children": single, "leaves": single, "saved": zero})
        nodes = _nodes(rows.withColumn("ends", ~F.col("more")), pending, block, k > 0)
        start = before(k)
        below = nodes.where("depth = 1")  # what each group's node has below it
        own = (nodes.where("depth > 1") if k else nodes).withColumn("depth", F.col("depth") + (start - 1))
        found += [own, _chains(on.where("k = 1").select("conv_id", "n", "g"), before(k + 1))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("ends", "ends_sha256")
