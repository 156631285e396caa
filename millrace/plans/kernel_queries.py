"""Queries over the numeric kernels; embeddings serve as activations (vec_id as position, slices of 8 as heads)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import kernels as K
from millrace.plans.catalog import query, table


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _long(df, key, column):
    return df.select(key, F.posexplode(column).alias("d", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


def _long_sql(expr: str, source: str = "embeddings") -> str:
    return f"SELECT vec_id, CAST(i - 1 AS INTEGER) AS d, round(xs[i], 6) + 0.0 AS value FROM (SELECT vec_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT vec_id, {expr} AS xs FROM {source}))"


_D = "embedding::DOUBLE[]"


@query("softmax", _long_sql("list_transform(e, lambda x: x / list_sum(e))", f"(SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, {_D} AS v FROM embeddings))"))
def softmax(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.softmax(K.doubles(F.col("embedding"))).alias("x")), "vec_id", "x")


@query("layer_norm", _long_sql("list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5))", f"(SELECT vec_id, {_D} AS v FROM embeddings)"))
def layer_norm(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.layer_norm(F.col("embedding")).alias("x")), "vec_id", "x")


@query("rms_norm", _long_sql("list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-6))", f"(SELECT vec_id, {_D} AS v FROM embeddings)"))
def rms_norm(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.rms_norm(F.col("embedding")).alias("x")), "vec_id", "x")


_FEATURES = f"(SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, {_D} AS v FROM embeddings)))"


@query("batch_norm", f"SELECT vec_id, feature, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 6) + 0.0 AS value FROM {_FEATURES} WINDOW w AS (PARTITION BY feature)")
def batch_norm(spark, sf_dir):
    e = _emb(spark, sf_dir).select("vec_id", K.doubles(F.col("embedding")).alias("x"))
    return K.batch_norm(e, "vec_id", "x").withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("sinusoidal", _long_sql("list_transform(range(16), lambda i: CASE WHEN i % 2 = 0 THEN sin(vec_id / power(10000.0, (2 * (i // 2)) / 16)) ELSE cos(vec_id / power(10000.0, (2 * (i // 2)) / 16)) END)"))
def sinusoidal(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.sinusoid(F.col("vec_id"), 16).alias("x")), "vec_id", "x")


@query(
    "rope",
    _long_sql("list_transform(range(1, 9), lambda i: v[i] * cos(vec_id * power(10000.0, -(2.0 * ((i - 1) % 4)) / 8)) + (CASE WHEN i <= 4 THEN -v[i + 4] ELSE v[i - 4] END) * sin(vec_id * power(10000.0, -(2.0 * ((i - 1) % 4)) / 8)))", f"(SELECT vec_id, ({_D})[1:8] AS v FROM embeddings)"),
)
def rope(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.rotary(F.slice("embedding", 1, 8), F.col("vec_id"), 8).alias("x")), "vec_id", "x")


@query(
    "rope_interleaved",
    _long_sql(
        "list_transform(range(1, 9), lambda i: v[i] * cos(vec_id * power(10000.0, -(2.0 * ((i - 1) % 4)) / 8)) + (CASE WHEN i <= 4 THEN -v[i + 4] ELSE v[i - 4] END) * sin(vec_id * power(10000.0, -(2.0 * ((i - 1) % 4)) / 8)))",
        f"(SELECT vec_id, [u[1], u[3], u[5], u[7], u[2], u[4], u[6], u[8]] AS v FROM (SELECT vec_id, {_D} AS u FROM embeddings))",
    ),
)
def rope_interleaved(spark, sf_dir):
    return _long(_emb(spark, sf_dir).select("vec_id", K.rotary(F.slice("embedding", 1, 8), F.col("vec_id"), 8, interleaved=True).alias("x")), "vec_id", "x")


@query("relative_bias", "SELECT a.vec_id AS i, b.vec_id AS j, CAST(least(greatest(b.vec_id - a.vec_id, -4), 4) + 4 AS INTEGER) AS bucket FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16")
def relative_bias(spark, sf_dir):
    """All pairs of positions of a sequence of 16 rows."""
    e = _emb(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 16).alias("seq"))
    both = e.withColumnRenamed("vec_id", "i").join(e.withColumnRenamed("vec_id", "j"), "seq")
    return both.select("i", "j", K.relative_bucket(F.col("i"), F.col("j"), 4).cast("int").alias("bucket"))


def _heads(spark, sf_dir, heads: int):
    e = _emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).cast("int").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"), "embedding")
    part = lambda at: F.slice("embedding", F.lit(at) + F.col("head") * 8, F.lit(8))
    return e.select("seq", "head", "pos", part(1).alias("q"), part(17).alias("k"), part(33).alias("v"))


def _attention_sql(heads: int, causal: bool, group: int) -> str:
    rows = f"SELECT vec_id // 16 AS seq, CAST(h AS INTEGER) AS head, CAST(vec_id % 16 AS INTEGER) AS pos, e[1 + h * 8 : 8 + h * 8] AS q, e[17 + h * 8 : 24 + h * 8] AS k, e[33 + h * 8 : 40 + h * 8] AS v FROM (SELECT vec_id, {_D} AS e, unnest(range({heads})) AS h FROM embeddings)"
    return f"""WITH r AS ({rows}), s AS (SELECT a.seq, a.head, a.pos, b.v, exp(list_inner_product(a.q, b.k) / sqrt(8)) AS e FROM r a JOIN r b ON a.seq = b.seq AND a.head // {group} = b.head {'AND b.pos <= a.pos' if causal else ''}),
      x AS (SELECT seq, head, pos, e, v, unnest(range(1, 9)) AS i FROM s) SELECT seq, head, pos, CAST(i - 1 AS INTEGER) AS d, round(sum(e * v[i]) / sum(e), 6) + 0.0 AS value FROM x GROUP BY seq, head, pos, i"""


for _name, _heads_n, _causal, _group in (("self_attention", 1, False, 1), ("multi_head_attention", 2, False, 1), ("grouped_attention", 2, False, 2), ("causal_attention", 1, True, 1), ("multi_query_attention", 4, False, 4)):

    @query(_name, _attention_sql(_heads_n, _causal, _group))
    def attention(spark, sf_dir, heads=_heads_n, causal=_causal, group=_group):
        return K.attention(_heads(spark, sf_dir, heads), causal, group).withColumn("value", F.round("value", 6) + F.lit(0.0))


def _gates(spark, sf_dir):
    return _emb(spark, sf_dir).select(F.col("vec_id").alias("token"), F.slice("embedding", 1, 8).alias("logits"))


_P = f"""p AS (SELECT token, expert, e / sum(e) OVER (PARTITION BY token) AS p FROM (SELECT vec_id AS token, CAST(i - 1 AS INTEGER) AS expert, exp(v[i]) AS e FROM (SELECT vec_id, v, unnest(range(1, 9)) AS i FROM (SELECT vec_id, {_D} AS v FROM embeddings)))),
  t AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY p DESC, expert) AS r FROM p)"""


@query("moe_topk", f"WITH {_P} SELECT token, expert, round(p / sum(p) OVER (PARTITION BY token), 6) AS weight FROM t WHERE r <= 2")
def moe_topk(spark, sf_dir):
    return K.route_top_k(_gates(spark, sf_dir), 2).withColumn("weight", F.round("weight", 6))


@query(
    "group_router",
    f"""WITH s AS (SELECT token, expert, expert // 2 AS g, p FROM (SELECT vec_id AS token, CAST(i - 1 AS INTEGER) AS expert, 1 / (1 + exp(-v[i])) AS p FROM (SELECT vec_id, v, unnest(range(1, 9)) AS i FROM (SELECT vec_id, {_D} AS v FROM embeddings)))),
    g AS (SELECT token, g, row_number() OVER (PARTITION BY token ORDER BY sum(p) DESC, g) AS r FROM s GROUP BY token, g),
    t AS (SELECT s.*, row_number() OVER (PARTITION BY s.token ORDER BY p DESC, expert) AS r FROM s JOIN g ON s.token = g.token AND s.g = g.g WHERE g.r <= 2)
    SELECT token, expert, round(p / (sum(p) OVER (PARTITION BY token) + 1e-20) * 2.5, 6) AS weight FROM t WHERE r <= 3""",
)
def group_router(spark, sf_dir):
    return K.route_groups(_gates(spark, sf_dir), 2, 2, 3, 2.5).withColumn("weight", F.round("weight", 6))


@query("moe_combine", f"WITH {_P}, w AS (SELECT token, expert, p / sum(p) OVER (PARTITION BY token) AS weight FROM t WHERE r <= 2) SELECT token, CAST(0 AS INTEGER) AS d, round(sum(weight * (expert + 1.0)), 6) AS value FROM w GROUP BY token")
def moe_combine(spark, sf_dir):
    routed = K.route_top_k(_gates(spark, sf_dir), 2)
    outputs = routed.select("token", "expert", F.array((F.col("expert") + 1).cast("double")).alias("y"))
    return K.combine_experts(routed, outputs).withColumn("value", F.round("value", 6))


@query("aux_loss", f"WITH {_P}, m AS (SELECT expert, avg(p) AS mean FROM p GROUP BY 1), c AS (SELECT expert, count(*) AS c FROM t WHERE r <= 2 GROUP BY 1) SELECT round(count(*) * sum(coalesce(c, 0) / (SELECT count(*) FROM embeddings) * mean), 6) AS loss FROM m LEFT JOIN c USING (expert)")
def aux_loss(spark, sf_dir):
    return K.balance_loss(_gates(spark, sf_dir), 2).select(F.round("loss", 6).alias("loss"))


@query("cross_entropy", f"WITH {_P} SELECT round(avg(-ln(p)), 6) AS loss FROM p JOIN embeddings e ON e.vec_id = token WHERE expert = label % 8 AND label % 8 <> 7")
def cross_entropy(spark, sf_dir):
    e = _emb(spark, sf_dir).select(F.slice("embedding", 1, 8).alias("logits"), F.when(F.col("label") % 8 == 7, -1).otherwise(F.col("label") % 8).alias("target"))
    return K.cross_entropy(e).select(F.round("loss", 6).alias("loss"))


@query("gated_mlp", f"SELECT vec_id, round(2.0 * (v[1] / (1 + exp(-v[1]))) * (v[1] + v[2]), 6) + 0.0 AS value FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def gated_mlp(spark, sf_dir):
    y = K.gated_mlp(F.slice("embedding", 1, 2), [[1, 0]], [[1, 1]], [[2]])
    return _emb(spark, sf_dir).select("vec_id", (F.round(F.get(y, F.lit(0)), 6) + F.lit(0.0)).alias("value"))


@query("lora_merge", f"""WITH m AS (SELECT vec_id AS i, CAST(d AS INTEGER) AS j, v[d + 1] AS value FROM (SELECT vec_id, {_D} AS v, unnest(range(8)) AS d FROM embeddings)), a AS (SELECT i, j AS r, value AS x FROM m WHERE j < 2), b AS (SELECT CAST(i AS INTEGER) AS r, j, value AS y FROM m WHERE i < 2)
  SELECT m.i, m.j, round(value + d, 6) + 0.0 AS value FROM m JOIN (SELECT a.i, b.j, sum(x * y) * (16 / 2) AS d FROM a JOIN b USING (r) GROUP BY 1, 2) ab ON m.i = ab.i AND m.j = ab.j""")
def lora_merge(spark, sf_dir):
    m = _emb(spark, sf_dir).select(F.col("vec_id").alias("i"), F.posexplode(F.slice(K.doubles(F.col("embedding")), 1, 8)).alias("j", "value"))
    a, b = m.where("j < 2"), m.where("i < 2").select(F.col("i").cast("int").alias("r"), "j", "value")
    return K.lora(m, a, b, 16, 2).withColumn("value", F.round("value", 6) + F.lit(0.0))
