"""Further queries over preference arithmetic, tokenizers, keywords and parameter selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import alignment, gazetteer
from millrace.operators import kernels as K
from millrace.operators import metrics as M
from millrace.operators import tokenizers as T
from millrace.operators import vector as V
from millrace.plans.catalog import query, table
from millrace.plans.dedup_queries import _words
from millrace.plans.metric_queries import _EV, _events, _rounded


@query(
    "next_token_logprobs",
    """WITH s AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS t, list_transform((embedding::DOUBLE[])[1:8], lambda x: x / 0.7) AS l, lead(label % 8) OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS nx FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t DESC) AS r FROM s WHERE nx IS NOT NULL)
    SELECT seq, t, round(l[nx + 1] - (ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) + list_max(l)), 6) AS logprob FROM r WHERE r <= 4""",
)
def next_token_logprobs(spark, sf_dir):
    i = F.col("vec_id")
    s = table(spark, sf_dir, "embeddings").select(F.floor(i / 16).alias("seq"), (i % 16).alias("t"), (F.col("label") % 8).alias("token"), F.slice("embedding", 1, 8).alias("logits"))
    return _rounded(M.next_token_logprobs(s, 4, 0.7), "logprob")


@query(
    "composite_reward",
    f"""SELECT conv_id, turn, round((0.4 * CASE WHEN length(text) < 20 THEN 0.3 WHEN contains(text, 'however') OR contains(text, 'therefore') OR contains(text, 'furthermore') THEN 0.9 ELSE 0.7 END
      + 0.4 * CASE WHEN contains(text, role) THEN 0.8 ELSE 0.6 END + 0.2 * CASE WHEN regexp_matches(text, '[!?]|amazing|important') THEN 0.9 ELSE 0.65 END) * least(len({_words('text')}) / 32, 1.0), 6)::DOUBLE AS reward FROM conversations""",
)
def composite_reward(spark, sf_dir):
    r = M.composite_reward(F.col("text"), F.col("role"), F.size(X.words(F.col("text"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(r, 6).alias("reward"))


@query(
    "reference_free_loss",
    f"""SELECT round(-avg(-ln(1 + exp(-0.1 * (r - c)))), 6) AS loss, round(avg(CASE WHEN r > c THEN 1.0 ELSE 0.0 END), 6) AS preference_accuracy
      FROM (SELECT seq, avg(CASE WHEN t < 4 THEN -logprob END) AS c, avg(CASE WHEN t >= 4 THEN -logprob END) AS r FROM {_EV} GROUP BY seq)""",
)
def reference_free_loss(spark, sf_dir):
    e = _events(spark, sf_dir)
    p = e.groupBy("seq").agg(F.avg(F.when(F.col("t") < 4, -F.col("logprob"))).alias("chosen_loss"), F.avg(F.when(F.col("t") >= 4, -F.col("logprob"))).alias("rejected_loss"))
    return _rounded(M.reference_free_loss(p))


@query(
    "collated_batch",
    f"""SELECT conv_id, turn, array_to_string(list_concat(ws, list_transform(range(w - len(ws)), lambda i: '<pad>')), ' ') AS tokens
      FROM (SELECT conv_id, turn, ws, max(len(ws)) OVER (PARTITION BY conv_id) AS w FROM (SELECT conv_id, turn, {_words('text')} AS ws FROM conversations))""",
)
def collated_batch(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("tokens"))
    return M.collated(c, "conv_id", "tokens").select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"))


@query("repeat_interleave", "SELECT conv_id, turn, CAST(copy AS INTEGER) AS copy FROM conversations, range(4) r(copy)")
def repeat_interleave(spark, sf_dir):
    return M.repeated(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 4)


@query("sampled_rows", "SELECT doc_id FROM documents ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '7')), doc_id LIMIT 16")
def sampled_rows(spark, sf_dir):
    """A sampling operator: the limit is the sample's size."""
    return M.sampled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16, 7)


@query("strip_accents", "SELECT conv_id, turn, strip_accents(lower(text)) AS text FROM conversations")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_accents(F.col("text")).alias("text"))


@query("framed_tokens", f"SELECT conv_id, turn, array_to_string(list_concat(['[CLS]'], {_words('text')}, ['[SEP]']), ' ') AS tokens FROM conversations")
def framed_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.framed(X.words(F.col("text"))), " ").alias("tokens"))


@query("cluster_sentences")
def cluster_sentences(spark, sf_dir):
    return V.cluster_sentences(table(spark, sf_dir, "documents"))


@query("keywords")
def keywords(spark, sf_dir):
    return V.keywords(table(spark, sf_dir, "documents"))


def _modules(spark, sf_dir):
    """Parts stand for modules: their names, and how many dimensions each parameter has."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("dim"))


@query("lora_targets", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'bolt') OR contains(p_name, 'red ')")
def lora_targets(spark, sf_dir):
    return K.lora_targets(_modules(spark, sf_dir), ["bolt", "red "]).select("id", "name")


@query("decay_groups", "SELECT p_partkey AS id, p_name AS name, CAST(p_size % 4 AS INTEGER) AS dim, CASE WHEN p_size % 4 >= 2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS weight_decay FROM part")
def decay_groups(spark, sf_dir):
    return K.decay_groups(_modules(spark, sf_dir), 0.1)


_W = f"(SELECT conv_id * 1000 + turn AS o, {_words('text')} AS ws FROM conversations)"
_END = f"(SELECT unnest(ws) AS w, o, generate_subscripts(ws, 1) AS i FROM {_W})"


@query(
    "joined_diversity",
    f"""SELECT round(count(DISTINCT w) / count(*), 6) AS distinct_1, round(count(DISTINCT CASE WHEN nx IS NOT NULL THEN w || chr(1) || nx END) / count(nx), 6) AS distinct_2
      FROM (SELECT w, lead(w) OVER (ORDER BY o, i) AS nx FROM {_END})""",
)
def joined_diversity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return _rounded(M.joined_bigram_diversity(c, "o"))


@query(
    "corpus_report",
    f"""SELECT * FROM (SELECT round(exp(sum(-logprob * tokens) / sum(tokens)), 6) AS perplexity FROM {_EV}),
      (SELECT round(max(CASE WHEN n = 1 THEN d END), 6) AS distinct_1, round(max(CASE WHEN n = 2 THEN d END), 6) AS distinct_2, round(max(CASE WHEN n = 3 THEN d END), 6) AS distinct_3, round(max(CASE WHEN n = 4 THEN d END), 6) AS distinct_4
       FROM (SELECT n, count(DISTINCT g) / count(*) AS d FROM (SELECT n, array_to_string(ws[i : i + n - 1], chr(1)) AS g FROM (SELECT n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM {_W}, range(1, 5) r(n) WHERE len(ws) >= n)) GROUP BY n)),
      (SELECT round(greatest(0.0, count(*) / count(DISTINCT text) - 1), 6) AS exact_duplicate_ratio FROM conversations)""",
)
def corpus_report(spark, sf_dir):
    losses = _events(spark, sf_dir).withColumn("loss", -F.col("logprob"))
    return _rounded(M.corpus_report(table(spark, sf_dir, "conversations"), losses))


_NAME_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    "gazetteer_entities",
    f"""WITH n AS (SELECT DISTINCT ws[1] || ' ' || ws[2] AS name FROM (SELECT {_NAME_WORDS} AS ws FROM conversations WHERE role = 'user') WHERE len(ws) >= 2),
      p AS (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT doc_id, {_NAME_WORDS} AS ws FROM documents))
      SELECT doc_id, name, 'opening' AS kind, count(*) AS n, CAST(min(i) - 1 AS INTEGER) AS first_at FROM p JOIN n ON ws[i] || ' ' || ws[i + 1] = name GROUP BY doc_id, name""",
)
def gazetteer_entities(spark, sf_dir):
    """The gazetteer: what user turns begin with, two words each."""
    ws = gazetteer.name_words(F.col("text"))
    names = table(spark, sf_dir, "conversations").where("role = 'user'").select(ws.alias("ws")).where("size(ws) >= 2").select(F.array_join(F.slice("ws", 1, 2), " ").alias("name"), F.lit("opening").alias("kind")).distinct()
    found = gazetteer.named(table(spark, sf_dir, "documents"), names)
    return found.groupBy("doc_id", "name", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


@query("meteor_stems")
def meteor_stems(spark, sf_dir):
    """Each turn of the assistant against its next one in the conversation."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.withColumn("next", after).where("next is not null").select("conv_id", "turn", F.round(alignment.meteor(F.col("text"), F.col("next")), 6).alias("meteor"))
