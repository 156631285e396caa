"""Forward numeric kernels over vectors in array columns and over long tables; no gradients, no weights of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.vector import dot


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _with(x: Column, f) -> Column:
    """f of x bound to a variable, so that x is made once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def softmax(x: Column) -> Column:
    e = lambda v: F.transform(v, lambda a: F.exp(a - F.array_max(v)))
    return _with(_with(x, e), lambda v: _with(total(v), lambda t: F.transform(v, lambda a: a / t)))


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    """Biased variance."""
    mean = lambda v: total(v) / F.size(v)
    centred = _with(doubles(x), lambda v: _with(mean(v), lambda m: F.transform(v, lambda a: a - m)))
    return _with(centred, lambda v: _with(F.sqrt(dot(v, v) / F.size(v) + epsilon), lambda s: F.transform(v, lambda a: a / s)))


def rms_norm(x: Column, epsilon: float = 1e-6) -> Column:
    return _with(doubles(x), lambda v: _with(F.sqrt(dot(v, v) / F.size(v) + epsilon), lambda s: F.transform(v, lambda a: a / s)))


def batch_norm(rows: DataFrame, key: str, vector: str, epsilon: float = 1e-5) -> DataFrame:
    """(key, feature, value): each feature over the whole batch, biased variance. Two aggregates a feature, then a small join."""
    each = rows.select(key, F.posexplode(vector).alias("feature", "x"))
    stats = each.groupBy("feature").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return each.join(stats, "feature").select(key, "feature", ((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + epsilon)).alias("value"))


def sinusoid(position: Column, dim: int) -> Column:
    angle = lambda i: position / F.pow(F.lit(10000.0), (2 * F.floor(i / 2)) / dim)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def rotary(x: Column, position: Column, dim: int, base: float = 10000.0, interleaved: bool = False) -> Column:
    """Rotation by position of the pairs (i, i + dim / 2); interleaved vectors are regrouped from (2 i, 2 i + 1) first."""
    if interleaved:
        x = F.concat(F.filter(x, lambda v, i: i % 2 == 0), F.filter(x, lambda v, i: i % 2 == 1))
    half = dim // 2
    angle = lambda i: position * F.pow(F.lit(base), -(2.0 * (i % half)) / dim)
    turned = lambda v, i: F.when(i < half, -F.get(v, i + half)).otherwise(F.get(v, i - half))
    return _with(doubles(x), lambda v: F.transform(v, lambda a, i: a * F.cos(angle(i)) + turned(v, i) * F.sin(angle(i))))


def relative_bucket(i: Column, j: Column, most: int) -> Column:
    return F.least(F.greatest(j - i, F.lit(-most)), F.lit(most)) + most


def attention(rows: DataFrame, causal: bool = False, group: int = 1) -> DataFrame:
    """(seq, head, pos, d, value) of rows (seq, head, pos, q, k, v). Heads h of queries use head floor(h / group) of keys.

    A join of positions within a sequence: the work is quadratic in a sequence's length, as attention is, and no more.
    """
    dim = F.size("q")
    q = rows.select("seq", "head", F.col("pos").alias("qpos"), doubles(F.col("q")).alias("q"), F.floor(F.col("head") / group).cast("int").alias("kv"))
    kv = rows.select("seq", F.col("head").alias("kv"), F.col("pos").alias("kpos"), doubles(F.col("k")).alias("k"), doubles(F.col("v")).alias("v"))
    met = q.join(kv, ["seq", "kv"])
    if causal:
        met = met.where("kpos <= qpos")
    scored = met.select("seq", "head", "qpos", "kpos", "v", (dot(F.col("q"), F.col("k")) / F.sqrt(dim)).alias("s"))
    w = Window.partitionBy("seq", "head", "qpos")
    weights = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    each = weights.select("seq", "head", "qpos", "e", F.posexplode("v").alias("d", "x"))
    return each.groupBy("seq", "head", "qpos", "d").agg((F.sum(F.col("e") * F.col("x")) / F.sum("e")).alias("value")).withColumnRenamed("qpos", "pos")


def route_top_k(gates: DataFrame, k: int, renormalise: bool = True) -> DataFrame:
    """(token, expert, weight) of gates (token, logits): softmax, the k largest (ties: the smaller expert)."""
    each = gates.select("token", F.posexplode(softmax(doubles(F.col("logits")))).alias("expert", "p"))
    w = Window.partitionBy("token").orderBy(F.desc("p"), "expert")
    top = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    weight = F.col("p") / F.sum("p").over(Window.partitionBy("token")) if renormalise else F.col("p")
    return top.select("token", "expert", weight.alias("weight"))


def route_groups(gates: DataFrame, group_size: int, groups: int, k: int, scale: float = 1.0) -> DataFrame:
    """Sigmoid scores; a group's score is the sum of its two best; the best groups' k best experts, renormalised and scaled."""
    each = gates.select("token", F.posexplode(F.transform("logits", lambda x: 1 / (1 + F.exp(-x.cast("double"))))).alias("expert", "p")).withColumn("g", F.floor(F.col("expert") / group_size).cast("int"))
    in_group = Window.partitionBy("token", "g").orderBy(F.desc("p"), "expert")
    best = each.withColumn("r", F.row_number().over(in_group)).where("r <= 2").groupBy("token", "g").agg(F.sum("p").alias("s"))
    chosen = best.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("s"), "g"))).where(F.col("r") <= groups).select("token", "g")
    w = Window.partitionBy("token").orderBy(F.desc("p"), "expert")
    top = each.join(chosen, ["token", "g"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select("token", "expert", (F.col("p") / (F.sum("p").over(Window.partitionBy("token")) + 1e-20) * scale).alias("weight"))


def combine_experts(routed: DataFrame, outputs: DataFrame) -> DataFrame:
    """(token, d, value): expert outputs (token, expert, y) weighted by the routing and summed."""
    each = routed.join(outputs, ["token", "expert"]).select("token", "weight", F.posexplode("y").alias("d", "x"))
    return each.groupBy("token", "d").agg(F.sum(F.col("weight") * F.col("x")).alias("value"))


def balance_loss(gates: DataFrame, k: int) -> DataFrame:
    """One row: experts * sum over experts of (share of tokens routed there) * (mean probability)."""
    p = gates.select("token", F.posexplode(softmax(doubles(F.col("logits")))).alias("expert", "p"))
    n = gates.agg(F.count("*").alias("tokens"))
    mean = p.groupBy("expert").agg(F.avg("p").alias("mean"))
    share = route_top_k(gates, k).groupBy("expert").agg(F.count("*").alias("c"))
    both = mean.join(share, "expert", "left").join(F.broadcast(n))  # n is one row
    return both.agg((F.count("*") * F.sum(F.coalesce("c", F.lit(0)) / F.col("tokens") * F.col("mean"))).alias("loss"))


def cross_entropy(steps: DataFrame, logits: str = "logits", target: str = "target", ignore: int = -1) -> DataFrame:
    """One row: mean of -log softmax at the targets, ignored ones left out."""
    from millrace.operators.metrics import log_softmax_at

    kept = steps.where(F.col(target) != ignore)
    return kept.agg(F.avg(-log_softmax_at(doubles(F.col(logits)), F.col(target))).alias("loss"))


def gated_mlp(x: Column, gate: list[list[float]], up: list[list[float]], down: list[list[float]]) -> Column:
    """down (silu(gate x) * up x); the weights are small literal matrices, one row an output."""
    rows = lambda m: F.array(*[F.array(*[F.lit(float(a)) for a in r]) for r in m])
    times = lambda m, v: F.transform(rows(m), lambda r: dot(r, v))
    silu = lambda v: F.transform(v, lambda a: a / (1 + F.exp(-a)))
    return _with(doubles(x), lambda v: times(down, F.zip_with(silu(times(gate, v)), times(up, v), lambda a, b: a * b)))


def lora(weight: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank: int) -> DataFrame:
    """(i, j, value): W + alpha / rank * (A B), matrices in long form (i, j, value)."""
    ab = a.toDF("i", "r", "x").join(b.toDF("r", "j", "y"), "r").groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) * (alpha / rank)).alias("d"))
    return weight.join(ab, ["i", "j"], "left").select("i", "j", (F.col("value") + F.coalesce("d", F.lit(0.0))).alias("value"))


def lora_targets(modules: DataFrame, targets: list[str], name: str = "name") -> DataFrame:
    """The modules whose name holds one of the targets."""
    return modules.where(F.exists(F.array(*[F.lit(t) for t in targets]), lambda t: F.contains(F.col(name), t)))


def decay_groups(parameters: DataFrame, decay: float) -> DataFrame:
    """parameters (name, dim) with weight_decay: that of matrices and above, none for vectors."""
    return parameters.withColumn("weight_decay", F.when(F.col("dim") >= 2, F.lit(decay)).otherwise(F.lit(0.0)))
