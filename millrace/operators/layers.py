"""Whole layers of a transformer over activations (seq, pos, x) and a table of weights (name, o, i, value).

Products with weights are done block by block of activations, as matrix products in the tasks; the weights, which are of
a counted and bounded size, are sent there once. Attention is a join of the positions of a sequence (`kernels.attention`).
Forward only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import kernels as K

#: Numbers that all weights of a layer may have together.
MAX_WEIGHTS = 50_000_000


def matrices(weights: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """name -> (matrix with a row an output, bias). The bias of an output has i = -1; places without a row are 0."""
    n = weights.count()
    if n > MAX_WEIGHTS:
        raise ValueError(f"{n} weights, {MAX_WEIGHTS} at most")
    out = {}
    rows = weights.select("name", F.col("o").cast("int").alias("o"), F.col("i").cast("int").alias("i"), F.col("value").cast("double").alias("value")).toPandas()
    for name, part in rows.groupby("name"):
        w, b = np.zeros((part["o"].max() + 1, max(0, part["i"].max()) + 1)), np.zeros(part["o"].max() + 1)
        own = part["i"] >= 0
        w[part["o"][own], part["i"][own]] = part["value"][own]
        b[part["o"][~own]] = part["value"][~own]
        out[name] = (w, b)
    return out


def rms(x: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + epsilon)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def turned(x: np.ndarray, pos: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """The last axis rotated by position, in pairs (i, i + dim / 2)."""
    half = x.shape[-1] // 2
    angle = pos[:, None] * base ** (-2.0 * np.arange(half) / (2 * half))
    angle = angle.reshape(len(pos), *[1] * (x.ndim - 2), half)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], axis=-1)


def by_block(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], inputs: list[str], outputs: list[str]) -> DataFrame:
    """(seq, pos, outputs) from f(positions, one matrix an input) of blocks of rows; inputs and outputs are arrays of doubles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            block = [part.column(2 + k).flatten().to_numpy().reshape(part.num_rows, -1) for k in range(len(inputs))]
            got = f(part.column(1).to_numpy().astype(float), *block)
            arrays = [pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * got[c].shape[1], np.ascontiguousarray(got[c]).ravel()) for c in outputs]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["seq", "pos", *outputs])

    kept = rows.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), *[K.doubles(F.col(c)).alias(c) for c in inputs])
    return kept.mapInArrow(run, ", ".join(["seq long", "pos long", *[f"{c} array<double>" for c in outputs]]))


def _attended(made: DataFrame, heads: int, kv_heads: int, causal: bool) -> DataFrame:
    """(seq, pos, a): attention of rows (seq, pos, q, k, v), heads one after the other, gathered to an array a position."""

    def part(name: str, n: int, at: Column) -> Column:
        width = F.size(name) / n
        return F.slice(name, (at * width + 1).cast("int"), width.cast("int"))

    head = F.explode(F.sequence(F.lit(0), F.lit(heads - 1)))
    # keys and values stand with the first kv_heads heads alone; a group of heads meets them there
    kv = F.least(F.col("head"), F.lit(kv_heads - 1))
    each = made.withColumn("head", head).select("seq", "head", "pos", part("q", heads, F.col("head")).alias("q"), part("k", kv_heads, kv).alias("k"), part("v", kv_heads, kv).alias("v"))
    values = K.attention(each, causal, heads // kv_heads)
    held = values.groupBy("seq", "pos").agg(F.sort_array(F.collect_list(F.struct("head", "d", "value"))).alias("vs"))  # one position's values
    return held.select("seq", "pos", F.transform("vs", lambda x: x["value"]).alias("a"))


def decoder_layer(rows: DataFrame, weights: DataFrame, heads: int, kv_heads: int, causal: bool = True) -> DataFrame:
    """(seq, pos, y): x + MLP(rms(x + attention(rms(x)))), with grouped rotary attention and a gated MLP.

    Both residual sums start from the layer's own input. Weights: q, k, v, o, gate, up, down.
    """
    m = matrices(weights)
    times = lambda name, x: x @ m[name][0].T + m[name][1]

    def project(pos: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        h = rms(x)
        split = lambda y, n: turned(y.reshape(len(y), n, -1), pos).reshape(len(y), -1)
        return {"q": split(times("q", h), heads), "k": split(times("k", h), kv_heads), "v": times("v", h)}

    def finish(pos: np.ndarray, x: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
        h = rms(x + times("o", a))
        return {"y": x + times("down", silu(times("gate", h)) * times("up", h))}

    attended = _attended(by_block(rows, project, ["x"], ["q", "k", "v"]), heads, kv_heads, causal)
    both = rows.join(attended.withColumnsRenamed({"seq": "s2", "pos": "p2"}), (F.col("seq") == F.col("s2")) & (F.col("pos") == F.col("p2")))
    return by_block(both, finish, ["x", "a"], ["y"])


def latent_attention(rows: DataFrame, weights: DataFrame, heads: int, nope: int, rope: int, rank: int, value: int, causal: bool = True) -> DataFrame:
    """(seq, pos, y): attention over a compressed key and value of `rank` numbers a position, and one rotary key for all heads.

    Weights: q_a, q_b (heads x (nope + rope)), kv_a (rank + rope), kv_b (heads x (nope + value)), o. A head's key part
    of kv_b is moved into its query and its value part behind the weighted sum, so what positions are joined with is the
    compressed row itself, once for all heads, never the keys and values that it stands for.
    """
    m = matrices(weights)
    times = lambda name, x: x @ m[name][0].T + m[name][1]
    up = m["kv_b"][0].reshape(heads, nope + value, rank)
    if m["kv_b"][1].any():
        raise ValueError("kv_b has no bias: it could not be moved past the sum")
    # attention divides by the root of the joined width, the layer by that of a head
    scale = np.sqrt(rank + rope) / np.sqrt(nope + rope)

    def project(pos: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        q = times("q_b", rms(times("q_a", x))).reshape(len(x), heads, nope + rope)
        kv = times("kv_a", x)
        c = rms(kv[:, :rank])
        moved = np.einsum("nhd,hdr->nhr", q[:, :, :nope], up[:, :nope])
        q = np.concatenate([moved, turned(q[:, :, nope:], pos)], axis=-1) * scale
        return {"q": q.reshape(len(x), -1), "k": np.concatenate([c, turned(kv[:, rank:], pos)], axis=-1), "v": c}

    def finish(pos: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
        v = np.einsum("nhr,hdr->nhd", a.reshape(len(a), heads, rank), up[:, nope:])
        return {"y": times("o", v.reshape(len(a), -1))}

    return by_block(_attended(by_block(rows, project, ["x"], ["q", "k", "v"]), heads, 1, causal), finish, ["a"], ["y"])
