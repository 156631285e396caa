"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

A document's token ids are followed by an end id. Documents longer than a sequence are cut: the first piece takes what
is over, every other piece is a whole sequence, so at most one piece a document has to be packed. The others are placed
longest first, each into the open sequence that makes the sum over the gaps of (open sequences with that gap) squared
smallest; a new sequence is opened where no open one has room.

Pieces are dealt evenly, by a hash of their row, to tasks of at most TASK_ROWS; what a task leaves open by more than a
32nd goes to a further round with fewer tasks, until one task is left. Only ids, lengths and checksums are moved,
never tokens; the tokenised pieces are written to the shared folder first, so later rounds do not tokenise again.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; a null id is carried; ties in
length go by id and piece; an empty table packs nothing; other columns are ignored and may have any name.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

CAPACITY = 1024
END_ID = 2
TASK_ROWS = 32_768

#: Text that the fast encoder is trusted with: its character classes agree there with the reference encoder's.
_PLAIN = re.compile(r"[^\x00-ɏ]")


def encoder(tokenizer_path: str, ranks_path: str | None):
    """A function text -> ids by the tokenizer file; the ranks file, if given, is a faster way to the same ids."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path)
    slow = lambda t: exact.encode(t, add_special_tokens=False).ids
    if ranks_path is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("millrace", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    probe = "It's été 1234,  \n\n ### foo-bar\tBaz's  x"
    if fast(probe) != slow(probe):
        return slow
    special = [str(t.content) for t in exact.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int]:
        if _PLAIN.search(text) or any(s in text for s in special):
            return slow(text)
        return fast(text)

    return ids


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what is over, the others are whole."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, paths: tuple[str, str | None] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and `ids` if asked for."""
    tokenizer_path, ranks_path = paths or default_paths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)
        for part in parts:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for r, text in enumerate(part.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if with_ids:
                        own.append(ids[s : s + n].astype(np.int32))
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence number, offset) of each length, which come longest first, and the gap that each sequence keeps."""
    open_count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    cost_from = np.zeros(capacity + 1, np.int64)  # what taking one away from a gap changes: 1 - 2 n, or out of reach
    cost_from[:] = np.iinfo(np.int64).max // 4
    cost_to = np.ones(capacity + 1, np.int64)  # what adding one to a gap changes: 1 + 2 n; a closed sequence counts for nothing
    cost_to[0] = 0
    gaps: list[int] = []
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def change(gap: int, by: int) -> None:
        open_count[gap] += by
        cost_from[gap] = 1 - 2 * open_count[gap] if open_count[gap] else np.iinfo(np.int64).max // 4
        cost_to[gap] = 1 + 2 * open_count[gap]

    for i, n in enumerate(lengths.tolist()):
        both = cost_from[n:capacity] + cost_to[: capacity - n]
        k = int(both.argmin()) if n < capacity else 0
        if n < capacity and open_count[n + k]:
            gap = n + k
            b = stacks[gap].pop()
            change(gap, -1)
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        seq[i], off[i] = b, capacity - gap
        gaps[b] = gap - n
        if gap > n:
            stacks[gap - n].append(b)
            change(gap - n, 1)
    return seq, off, np.array(gaps, np.int64)


def _round(rows: DataFrame, tasks: int, number: int, capacity: int) -> DataFrame:
    """rows (without a place) with sequence_id, offset and `loose`: its sequence was left open by more than a 32nd."""
    names = rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(parts)
        if not got:
            return
        table = pa.Table.from_batches(got)
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        seq, off, gaps = place(table["length"].to_numpy(), capacity)
        ids = ((np.int64(TaskContext.get().partitionId()) << 24) + seq) * 32 + number
        table = table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(off)).append_column("loose", pa.array(gaps[seq] * 32 > capacity))
        yield from table.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, loose boolean"
    dealt = rows.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(number))) if tasks > 1 else rows.coalesce(1)
    return dealt.select(names).mapInArrow(run, schema)


def pack(made: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> DataFrame:
    """made: rows of `pieces`. Each with its sequence_id and offset. Sequences are gapless from 0."""
    whole = made.where(F.col("length") >= capacity).select("*", (F.monotonically_increasing_id() * 32).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest, number = whole, made.where(F.col("length") < capacity), 1
    left = rest.count()
    while left:
        tasks = -(-left // task_rows)
        if tasks == 1 or number == 31:
            return out.unionByName(_round(rest, tasks, number, capacity).drop("loose"))
        done = stored(_round(rest, tasks, number, capacity), f"pack{number}")
        out = out.unionByName(done.where("not loose").drop("loose"))
        rest = done.where("loose").drop("loose", "sequence_id", "offset")
        before, left, number = left, rest.count(), number + 1
        if left > 0.7 * before:  # hardly anything fits together: further rounds would change little
            return out.unionByName(done.where("loose").drop("loose"))
    return out


def pack_documents(docs: DataFrame, paths: tuple[str, str | None] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    return pack(stored(pieces(docs, paths, capacity, with_ids=with_ids), "pieces"), capacity)
