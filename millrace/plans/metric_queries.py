"""Queries over metrics and preference arithmetic. Log-probabilities and rewards are made of the events' ids by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import metrics as M
from millrace.plans.catalog import query, table
from millrace.plans.dedup_queries import _words
from millrace.plans.text_queries import _TAGGED, _strip, tagged

_NGRAMS = f"SELECT n, array_to_string(ws[i : i + n - 1], chr(1)) AS g FROM (SELECT n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT {_words('text')} AS ws FROM conversations), range(1, 5) r(n) WHERE len(ws) >= n)"


@query("diversity_1_4", f"SELECT CAST(n AS INTEGER) AS n, count(DISTINCT g) AS \"distinct\", count(*) AS total, round(count(DISTINCT g) / count(*), 6) AS distinct_ratio, round(1 - count(DISTINCT g) / count(*), 6) AS repetition FROM ({_NGRAMS}) GROUP BY n")
def diversity_1_4(spark, sf_dir):
    d = M.diversity(table(spark, sf_dir, "conversations"))
    return d.withColumn("distinct_ratio", F.round("distinct_ratio", 6)).withColumn("repetition", F.round("repetition", 6))


@query("distinct_2", f"SELECT round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM ({_NGRAMS}) WHERE n = 2")
def distinct_2(spark, sf_dir):
    return M.diversity(table(spark, sf_dir, "conversations"), range(2, 3)).select(F.round("distinct_ratio", 6).alias("distinct_2"))


@query("duplicate_ratio", "SELECT round(greatest(0.0, count(*) / count(DISTINCT text) - 1), 6) AS exact_duplicate_ratio FROM documents")
def duplicate_ratio(spark, sf_dir):
    return M.duplicate_ratio(table(spark, sf_dir, "documents")).select(F.round("exact_duplicate_ratio", 6).alias("exact_duplicate_ratio"))


@query(
    "repetition_rate",
    f"""SELECT CAST(sum(len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))) AS BIGINT) AS repeats, CAST(sum(len(ws)) AS BIGINT) AS words,
        round(sum(len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1]))) / sum(len(ws)), 6) AS repetition_rate FROM (SELECT {_words('text')} AS ws FROM documents)""",
)
def repetition_rate(spark, sf_dir):
    return M.repetition_rate(table(spark, sf_dir, "documents")).withColumn("repetition_rate", F.round("repetition_rate", 6))


_EV = """(SELECT event_id, event_id // 8 AS seq, event_id % 8 AS t, -((event_id * 37) % 1000) / 250.0 AS logprob, -((event_id * 41) % 997) / 250.0 AS ref_logprob, -((event_id * 43) % 1000) / 250.0 AS old_logprob,
  ((event_id * 17) % 100) / 50.0 - 1 AS advantage, CASE WHEN event_id % 8 < 6 THEN 1.0 ELSE 0.0 END AS mask, ((event_id * 7) % 10) / 5.0 AS reward, ((event_id * 13) % 10) / 10.0 AS val, 1 + event_id % 5 AS tokens FROM events)"""


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    return e.select(
        "event_id", F.floor(i / 8).alias("seq"), (i % 8).alias("t"), (-((i * 37) % 1000) / 250.0).alias("logprob"), (-((i * 41) % 997) / 250.0).alias("ref_logprob"), (-((i * 43) % 1000) / 250.0).alias("old_logprob"),
        (((i * 17) % 100) / 50.0 - 1).alias("advantage"), F.when(i % 8 < 6, 1.0).otherwise(0.0).alias("mask"), (((i * 7) % 10) / 5.0).alias("reward"), (((i * 13) % 10) / 10.0).alias("val"), (1 + i % 5).alias("tokens"),
    )


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if not names or c in names else F.col(c) for c in df.columns])


@query("perplexity", f"SELECT round(exp(sum(-logprob * tokens) / sum(tokens)), 6) AS perplexity FROM {_EV}")
def perplexity(spark, sf_dir):
    return _rounded(M.perplexity(_events(spark, sf_dir).withColumn("loss", -F.col("logprob"))))


@query("sequence_perplexity", f"SELECT round(exp(avg(nll)), 6) AS perplexity FROM (SELECT seq, sum(-logprob * mask) / sum(mask) AS nll FROM {_EV} GROUP BY seq HAVING sum(mask) > 0)")
def sequence_perplexity(spark, sf_dir):
    return _rounded(M.sequence_perplexity(_events(spark, sf_dir).where((F.col("t") < 6))))


_PAIR = "(SELECT a.conv_id * 1000 + a.turn AS id, a.text AS candidate, concat(a.text, ' ', b.text) AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("candidate"), F.concat("text", F.lit(" "), "next").alias("reference"))


def _bleu_sql(pair: str = _PAIR) -> str:
    grams = lambda col, n: f"SELECT id, array_to_string({col}[i : i + {n - 1}], chr(1)) AS g, count(*) AS k FROM (SELECT id, {col}, unnest(range(1, len({col}) - {n} + 2)) AS i FROM w WHERE len({col}) >= {n}) GROUP BY 1, 2"
    parts = [f"WITH w AS (SELECT id, {_words('candidate')} AS c, {_words('reference')} AS r FROM {pair})"]
    for n in range(1, 5):
        parts.append(f"m{n} AS (SELECT a.id, sum(least(a.k, b.k)) AS m FROM ({grams('c', n)}) a JOIN ({grams('r', n)}) b ON a.id = b.id AND a.g = b.g GROUP BY 1)")
    logs = " + ".join(f"ln(CASE WHEN coalesce(m{n}.m, 0) > 0 THEN m{n}.m ELSE 0.1 END / greatest(1, len(c) - {n - 1}))" for n in range(1, 5))
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.id = w.id" for n in range(1, 5))
    return ", ".join(parts) + f" SELECT w.id, round(CASE WHEN len(c) = 0 OR len(r) = 0 OR coalesce(m1.m, 0) = 0 THEN 0.0 ELSE CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / greatest(1, len(c))) END * exp(({logs}) / 4) END, 6) AS bleu FROM w {joins}"


@query("bleu4", _bleu_sql())
def bleu4(spark, sf_dir):
    return _rounded(M.bleu(_pairs(spark, sf_dir)), "bleu")


_METEOR = f"""WITH p AS (SELECT id, {_words('lower(candidate)')} AS c, {_words('lower(reference)')} AS r FROM {_PAIR}),
  c AS (SELECT id, w, i, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(c) AS w, generate_subscripts(c, 1) AS i FROM p)),
  r AS (SELECT id, w, i AS j, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM p)),
  m AS (SELECT id, i, j, lag(i) OVER q AS pi, lag(j) OVER q AS pj FROM c JOIN r USING (id, w, k) WINDOW q AS (PARTITION BY id ORDER BY i)),
  n AS (SELECT id, count(*) AS hits, count(*) FILTER (pi IS NULL OR pi <> i - 1 OR pj <> j - 1) AS chunks FROM m GROUP BY id)
  SELECT p.id, round(coalesce(10.0 * (hits / len(c)) * (hits / len(r)) / (hits / len(r) + 9.0 * (hits / len(c))) * (1 - 0.5 * power(chunks / hits, 3)), 0.0), 6) AS meteor FROM p LEFT JOIN n USING (id)"""


@query("meteor", _METEOR)
def meteor(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(M.meteor(F.col("candidate"), F.col("reference")), 6).alias("meteor"))


_EXPECT = _strip("text")


@query(
    "rule_rewards",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(r, '(?s)^\s*<thinking>.*?</thinking>\s*<answer>.*?</answer>\s*$') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS format,
        CASE WHEN regexp_matches(r, '(?s)<thinking>.*?</thinking>') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS think,
        CASE WHEN {_strip("regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1)")} = {_EXPECT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness FROM (SELECT conv_id, turn, text, {_TAGGED} AS r FROM conversations)""",
)
def rule_rewards(spark, sf_dir):
    t = tagged(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "turn", M.rule_rewards(F.col("response"), X.strip(F.col("text"))).alias("r")).select("conv_id", "turn", "r.*")


@query(
    "reward_rollup",
    rf"""SELECT count(*) AS samples, round(avg(2.0 * f + t + c), 6) AS mean_reward, round(avg(c), 6) AS accuracy FROM (SELECT
        CASE WHEN regexp_matches(r, '(?s)^\s*<thinking>.*?</thinking>\s*<answer>.*?</answer>\s*$') THEN 1.0 ELSE 0.0 END AS f, CASE WHEN regexp_matches(r, '(?s)<thinking>.*?</thinking>') THEN 1.0 ELSE 0.0 END AS t,
        CASE WHEN {_strip("regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1)")} = {_EXPECT} THEN 1.0 ELSE 0.0 END AS c FROM (SELECT text, {_TAGGED} AS r FROM conversations))""",
)
def reward_rollup(spark, sf_dir):
    r = rule_rewards(spark, sf_dir)
    total = F.col("format") + F.col("think") + F.col("correctness")
    return r.agg(F.count("*").alias("samples"), F.round(F.avg(total), 6).alias("mean_reward"), F.round(F.avg("correctness"), 6).alias("accuracy"))


@query("group_advantage", f"SELECT event_id, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-4), 6) AS advantage FROM (SELECT * EXCLUDE (advantage) FROM {_EV}) WINDOW w AS (PARTITION BY event_id // 4)")
def group_advantage(spark, sf_dir):
    e = _events(spark, sf_dir).drop("advantage").withColumn("g", F.floor(F.col("event_id") / 4))
    return _rounded(M.group_advantages(e, "g").select("event_id", "advantage"), "advantage")


@query(
    "token_advantages",
    f"""SELECT event_id, CAST(t AS INTEGER) AS t, round(coalesce((reward - avg(reward) OVER w) / nullif(stddev_samp(reward) OVER w, 0), 0), 6)::DOUBLE AS advantage
      FROM (SELECT event_id, reward FROM {_EV}), range(3) r(t) WINDOW w AS (PARTITION BY event_id // 4, t)""",
)
def token_advantages(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "reward", F.floor(F.col("event_id") / 4).alias("g"))
    return _rounded(M.token_advantages(e, "g", 3).select("event_id", F.posexplode("advantages").alias("t", "advantage")), "advantage")


@query(
    "return_advantages",
    f"""WITH e AS (SELECT seq // 4 AS g, seq, t, reward FROM {_EV}), k AS (SELECT seq, t, reward, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS i FROM e),
      r AS (SELECT a.seq // 4 AS g, a.seq, a.i, sum(b.reward * power(0.9, b.i - a.i)) AS ret FROM k a JOIN k b ON a.seq = b.seq AND b.i >= a.i GROUP BY ALL)
      SELECT g, seq, CAST(i AS INTEGER) AS t, round(coalesce((ret - avg(ret) OVER w) / nullif(round(stddev_samp(ret) OVER w, 9), 0), 0), 4) AS advantage FROM r WINDOW w AS (PARTITION BY g, i)""",
)
def return_advantages(spark, sf_dir):
    a = _arrays(spark, sf_dir).select(F.floor(F.col("seq") / 4).alias("g"), "seq", F.transform("s", lambda x: x["reward"].cast("double")).alias("rewards"))
    got = M.return_advantages(a, "g", "seq", 0.9)
    return got.withColumn("advantage", F.round(F.when(F.abs("advantage") > 1e3, 0.0).otherwise(F.col("advantage")), 4))


@query("sequence_logprob", f"SELECT seq, round(sum(logprob * mask), 6)::DOUBLE AS logprob FROM {_EV} GROUP BY seq")
def sequence_logprob(spark, sf_dir):
    return _rounded(M.sequence_logprob(_events(spark, sf_dir)), "logprob")


@query("response_logprobs", f"SELECT seq, CAST(i - 3 AS INTEGER) AS t, round(logprob * mask, 6)::DOUBLE + 0.0 AS logprob FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS i FROM {_EV}) WHERE i >= 3")
def response_logprobs(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("t", "logprob", "mask")))
    e = _events(spark, sf_dir).groupBy("seq").agg(s.alias("s"))
    got = M.response_logprobs(F.transform("s", lambda x: x["logprob"].cast("double")), F.transform("s", lambda x: x["mask"].cast("double")), 3)
    return e.select("seq", F.posexplode(got).alias("t", "logprob")).withColumn("logprob", F.round("logprob", 6) + F.lit(0.0))


def _arrays(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = F.array_sort(F.collect_list(F.struct("t", "reward", "val", "mask")))
    return e.groupBy("seq").agg(s.alias("s"))


@query(
    "gae",
    f"""WITH RECURSIVE e AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY t DESC) AS k, t, reward, val, mask FROM {_EV}),
    r AS (SELECT seq, k, t, CAST(reward * mask - val AS DOUBLE) AS a, CAST(val AS DOUBLE) AS v FROM e WHERE k = 1
          UNION ALL SELECT e.seq, e.k, e.t, CAST(e.reward * e.mask + 0.99 * r.v * e.mask - e.val + 0.99 * 0.95 * e.mask * r.a AS DOUBLE), CAST(e.val AS DOUBLE) FROM r JOIN e ON e.seq = r.seq AND e.k = r.k + 1)
    SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS INTEGER) AS step, round(a, 6) AS advantage FROM r""",
)
def gae(spark, sf_dir):
    a = _arrays(spark, sf_dir)
    each = lambda f: F.transform("s", lambda x: x[f].cast("double"))
    got = a.select("seq", each("reward").alias("r"), each("val").alias("v"), each("mask").alias("m"))
    return _rounded(got.select("seq", F.posexplode(M.gae(F.col("r"), F.col("v"), F.col("m"))).alias("step", "advantage")), "advantage")


@query("discounted_returns", f"""WITH RECURSIVE e AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY t DESC) AS k, t, reward FROM {_EV}),
    r AS (SELECT seq, k, t, CAST(reward AS DOUBLE) AS g FROM e WHERE k = 1 UNION ALL SELECT e.seq, e.k, e.t, CAST(e.reward + 0.9 * r.g AS DOUBLE) FROM r JOIN e ON e.seq = r.seq AND e.k = r.k + 1)
    SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY t) - 1 AS INTEGER) AS step, round(g, 6) AS ret FROM r""")
def discounted_returns(spark, sf_dir):
    a = _arrays(spark, sf_dir).select("seq", F.transform("s", lambda x: x["reward"].cast("double")).alias("r"))
    return _rounded(a.select("seq", F.posexplode(M.discounted(F.col("r"), 0.9)).alias("step", "ret")), "ret")


@query("kl_k3", f"SELECT event_id, round(exp(ref_logprob - logprob) - (ref_logprob - logprob) - 1, 6) AS kl FROM {_EV}")
def kl_k3(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(M.kl_k3(F.col("logprob"), F.col("ref_logprob")), 6).alias("kl"))


@query("kl_penalty", f"SELECT round(avg(kl), 6) AS kl FROM (SELECT seq, sum(logprob - ref_logprob) AS kl FROM {_EV} GROUP BY seq)")
def kl_penalty(spark, sf_dir):
    return _rounded(M.ppo_loss(_events(spark, sf_dir)).select("kl"))


_CLIP = "least(exp(logprob - old_logprob) * advantage, least(greatest(exp(logprob - old_logprob), 0.8), 1.2) * advantage)"


@query("clipped_loss", f"SELECT round(avg(l), 6) AS loss FROM (SELECT seq, sum((-{_CLIP} + 0.04 * (exp(ref_logprob - logprob) - (ref_logprob - logprob) - 1)) * mask) / sum(mask) AS l FROM {_EV} WHERE t < 6 GROUP BY seq)")
def clipped_loss(spark, sf_dir):
    return _rounded(M.grpo_loss(_events(spark, sf_dir).where(F.col("t") < 6)))


@query(
    "ppo_loss",
    f"""SELECT round(p, 6) AS policy_loss, round(h, 6) AS entropy, round(k, 6) AS kl, round(p + 0.1 * k - 0.01 * h, 6) AS loss FROM (SELECT avg(-{_CLIP}) AS p, avg(-exp(logprob) * logprob) AS h FROM {_EV}),
        (SELECT avg(kl) AS k FROM (SELECT seq, sum(logprob - ref_logprob) AS kl FROM {_EV} GROUP BY seq))""",
)
def ppo_loss(spark, sf_dir):
    return _rounded(M.ppo_loss(_events(spark, sf_dir)))


_DPO = f"(SELECT seq, sum(CASE WHEN t < 4 THEN logprob ELSE 0 END) AS pc, sum(CASE WHEN t >= 4 THEN logprob ELSE 0 END) AS pr, sum(CASE WHEN t < 4 THEN ref_logprob ELSE 0 END) AS rc, sum(CASE WHEN t >= 4 THEN ref_logprob ELSE 0 END) AS rr FROM {_EV} GROUP BY seq)"


@query("dpo_loss", f"SELECT round(-avg(-ln(1 + exp(-0.1 * ((pc - pr) - (rc - rr))))), 6) AS loss, round(avg(CASE WHEN (pc - pr) - (rc - rr) > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM {_DPO}")
def dpo_loss(spark, sf_dir):
    e = _events(spark, sf_dir)
    part = lambda c, first: F.sum(F.when((F.col("t") < 4) == F.lit(first), F.col(c)).otherwise(0.0))
    p = e.groupBy("seq").agg(part("logprob", True).alias("policy_chosen"), part("logprob", False).alias("policy_rejected"), part("ref_logprob", True).alias("ref_chosen"), part("ref_logprob", False).alias("ref_rejected"))
    return _rounded(M.dpo_loss(p))


@query("value_loss", f"SELECT round(avg((val - reward) ** 2), 6) AS value_loss FROM {_EV} WHERE mask > 0")
def value_loss(spark, sf_dir):
    return _rounded(_events(spark, sf_dir).where("mask > 0").agg(F.avg(F.pow(F.col("val") - F.col("reward"), F.lit(2.0))).alias("value_loss")))


@query("count_buffer", "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS buffer FROM events")
def count_buffer(spark, sf_dir):
    return M.count_buffers(table(spark, sf_dir, "events").select("event_id", "user_id"), 16, "event_id", "user_id")


@query("best_checkpoint", f"SELECT seq, score FROM (SELECT seq, round(avg(reward), 6) AS score FROM {_EV} GROUP BY seq) ORDER BY score DESC, seq LIMIT 1")
def best_checkpoint(spark, sf_dir):
    return M.best(_rounded(_events(spark, sf_dir).groupBy("seq").agg(F.avg("reward").alias("score")), "score"), "score", "seq")


@query("kl_controller", "SELECT user_id, round(list_reduce(list(value / 50 ORDER BY event_id), lambda c, k: greatest(0.0::DOUBLE, c + 0.015 * (k - 6.0)), 0.1::DOUBLE), 6) + 0.0 AS coef FROM events GROUP BY user_id")
def kl_controller(spark, sf_dir):
    """A controller a user, its KLs made of the events' values."""
    kls = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 50).alias("kl"))
    return M.kl_controllers(kls, "user_id", "event_id", "kl", 0.1, 6.0, 0.015).select("user_id", (F.round("coef", 6) + F.lit(0.0)).alias("coef"))


@query("until_eos", "SELECT conv_id, turn, array_to_string(CASE WHEN list_position(ws, 'the') > 0 THEN ws[1 : list_position(ws, 'the')] ELSE ws END, ' ') AS kept FROM (SELECT conv_id, turn, " + _words("text") + " AS ws FROM conversations)")
def until_eos(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(M.until_eos(X.words(F.col("text")), "the"), " ").alias("kept"))
