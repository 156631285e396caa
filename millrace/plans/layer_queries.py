"""Queries over whole layers: embeddings are the activations, 16 rows a sequence; the weights are a table that Spark makes of a formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import layers as L
from millrace.plans.catalog import query, table

#: The layers' shapes, name -> (outputs, inputs, phase).
DECODER = {"q": (64, 64, 1), "k": (32, 64, 2), "v": (32, 64, 3), "o": (64, 64, 4), "gate": (96, 64, 5), "up": (96, 64, 6), "down": (64, 96, 7)}
LATENT = {"q_a": (16, 64, 1), "q_b": (24, 16, 2), "kv_a": (20, 64, 3), "kv_b": (32, 16, 4), "o": (64, 16, 5)}


def weights(spark, shapes: dict[str, tuple[int, int, int]]):
    """value(o, i) = sin(1.7 o + 0.9 i + phase + 0.01 o i) / 4."""
    parts = []
    for name, (outs, ins, phase) in shapes.items():
        o, i = F.floor(F.col("id") / ins), F.col("id") % ins
        parts.append(spark.range(outs * ins).select(F.lit(name).alias("name"), o.alias("o"), i.alias("i"), (F.sin(1.7 * o + 0.9 * i + phase + 0.01 * o * i) / 4).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("pos"), F.col("embedding").alias("x"))


def _long(df):
    return df.select((F.col("seq") * 16 + F.col("pos")).alias("vec_id"), F.posexplode("y").alias("d", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


def _lin(x: str, shape: tuple[int, int, int]) -> str:
    outs, ins, phase = shape
    return f"list_transform(range({outs}), lambda o: list_sum(list_transform(range({ins}), lambda i: {x}[i + 1] * sin(1.7 * o + 0.9 * i + {phase} + 0.01 * o * i) / 4)))"


def _rms(x: str) -> str:
    return f"list_transform({x}, lambda u: u / sqrt(list_sum(list_transform({x}, lambda z: z * z)) / len({x}) + 1e-6))"


def _turn(x: str, dim: int) -> str:
    half = dim // 2
    angle = f"(pos * power(10000.0, -(2.0 * (j % {half})) / {dim}))"
    return f"list_transform(range({dim}), lambda j: {x}[j + 1] * cos({angle}) + (CASE WHEN j < {half} THEN -{x}[j + {half} + 1] ELSE {x}[j - {half} + 1] END) * sin({angle}))"


_X = "b AS MATERIALIZED (SELECT vec_id, vec_id // 16 AS seq, vec_id % 16 AS pos, embedding::DOUBLE[] AS x FROM embeddings)"
_OUT = "SELECT vec_id, CAST(i - 1 AS INTEGER) AS d, round(y[i], 5) + 0.0 AS value FROM (SELECT vec_id, y, unnest(range(1, 65)) AS i FROM y)"


def _attend_sql(heads: int, width: int, out: int) -> str:
    """s: rows (vec_id, seq, pos, h, q, k, v) -> a: (vec_id, a)."""
    return f"""w AS (SELECT p.vec_id, p.h, r.v, exp(list_inner_product(p.q, r.k) / sqrt({width})) AS e FROM s p JOIN s r ON p.seq = r.seq AND p.h = r.h AND r.pos <= p.pos),
      f AS (SELECT vec_id, h, i, sum(e * v[i]) / sum(e) AS x FROM (SELECT vec_id, h, e, v, unnest(range(1, {out + 1})) AS i FROM w) GROUP BY ALL),
      a AS MATERIALIZED (SELECT vec_id, list(x ORDER BY h, i) AS a FROM f GROUP BY vec_id)"""


def _plus(a: str, b: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda k: {a}[k] + {b}[k])"


_DECODER_SQL = f"""WITH {_X}, n AS MATERIALIZED (SELECT *, {_rms("x")} AS h0 FROM b),
  p AS MATERIALIZED (SELECT vec_id, seq, pos, {_lin("h0", DECODER["q"])} AS q, {_lin("h0", DECODER["k"])} AS k, {_lin("h0", DECODER["v"])} AS v FROM n),
  s0 AS (SELECT vec_id, seq, pos, h, q[h * 16 + 1 : h * 16 + 16] AS q, k[(h // 2) * 16 + 1 : (h // 2) * 16 + 16] AS k, v[(h // 2) * 16 + 1 : (h // 2) * 16 + 16] AS v FROM (SELECT *, unnest(range(4)) AS h FROM p)),
  s AS MATERIALIZED (SELECT vec_id, seq, pos, h, {_turn("q", 16)} AS q, {_turn("k", 16)} AS k, v FROM s0), {_attend_sql(4, 16, 16)},
  r0 AS MATERIALIZED (SELECT vec_id, x, {_lin("a", DECODER["o"])} AS o FROM a JOIN b USING (vec_id)), r1 AS MATERIALIZED (SELECT vec_id, x, {_plus("x", "o")} AS r FROM r0), r2 AS MATERIALIZED (SELECT vec_id, x, {_rms("r")} AS h FROM r1),
  g AS MATERIALIZED (SELECT vec_id, x, {_lin("h", DECODER["gate"])} AS g, {_lin("h", DECODER["up"])} AS u FROM r2),
  z AS MATERIALIZED (SELECT vec_id, x, list_transform(range(1, 97), lambda k: g[k] / (1 + exp(-g[k])) * u[k]) AS z FROM g),
  d AS MATERIALIZED (SELECT vec_id, x, {_lin("z", DECODER["down"])} AS m FROM z), y AS MATERIALIZED (SELECT vec_id, {_plus("x", "m")} AS y FROM d)
  {_OUT}"""

_LATENT_SQL = f"""WITH {_X}, p0 AS MATERIALIZED (SELECT vec_id, seq, pos, {_lin("x", LATENT["q_a"])} AS qa, {_lin("x", LATENT["kv_a"])} AS ka FROM b),
  p1 AS MATERIALIZED (SELECT vec_id, seq, pos, {_rms("qa")} AS qn, ka[1:16] AS c0, ka[17:20] AS kr FROM p0), p2 AS MATERIALIZED (SELECT vec_id, seq, pos, qn, {_rms("c0")} AS c, {_turn("kr", 4)} AS kr FROM p1),
  p3 AS MATERIALIZED (SELECT vec_id, seq, pos, kr, {_lin("qn", LATENT["q_b"])} AS q, {_lin("c", LATENT["kv_b"])} AS kv FROM p2),
  s0 AS (SELECT vec_id, seq, pos, h, kr, q[h * 12 + 1 : h * 12 + 8] AS qn, q[h * 12 + 9 : h * 12 + 12] AS qr, kv[h * 16 + 1 : h * 16 + 8] AS kn, kv[h * 16 + 9 : h * 16 + 16] AS v FROM (SELECT *, unnest(range(2)) AS h FROM p3)),
  s AS MATERIALIZED (SELECT vec_id, seq, pos, h, list_concat(qn, {_turn("qr", 4)}) AS q, list_concat(kn, kr) AS k, v FROM s0), {_attend_sql(2, 12, 8)},
  y AS MATERIALIZED (SELECT vec_id, {_lin("a", LATENT["o"])} AS y FROM a)
  {_OUT}"""


@query("decoder_layer", _DECODER_SQL)
def decoder_layer(spark, sf_dir):
    return _long(L.decoder_layer(_rows(spark, sf_dir), weights(spark, DECODER), 4, 2))


@query("latent_attention", _LATENT_SQL)
def latent_attention(spark, sf_dir):
    return _long(L.latent_attention(_rows(spark, sf_dir), weights(spark, LATENT), 2, 8, 4, 16, 8))
