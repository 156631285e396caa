"""Evaluation metrics and preference arithmetic over given log-probabilities, by built-in expressions and aggregates."""

from __future__ import annotations

from collections import Counter
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.ordering import preceded


def ngrams(words: Column, n: int) -> Column:
    none = F.array().cast("array<array<string>>")
    return F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.slice(ws, i, n))).otherwise(none)))


#: Words whose n-grams of one order a task holds, on average.
TASK_WORDS = 1_000_000


def hashed_ngrams(words: Column, n: int) -> Column:
    """All runs of n words, each as two 64-bit hashes (a, b)."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def one(ws: Column, i: Column) -> Column:
        g = [F.get(ws, i + k) for k in range(n)]  # words one by one: a slice copies them
        return F.struct(F.xxhash64(*g).alias("a"), F.xxhash64(F.lit(n), *g).alias("b"))

    return F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: one(ws, i))).otherwise(none)))


def diversity(texts: DataFrame, orders: range = range(1, 5), text: str = "text") -> DataFrame:
    """(n, distinct, total, distinct_ratio, repetition) for each order.

    Totals follow from the texts' lengths; only distinct n-grams meet, by their hashes. N-grams of two words or more are
    dealt to as many tasks as the table's words need (TASK_WORDS), so that a task does not hold more in a larger table;
    single words, some of which are very frequent, are made distinct before they are dealt.
    """
    ws = texts.select(X.words(F.col(text)).alias("ws"))
    sums = ws.agg(*[F.sum(F.greatest(F.lit(0), F.size("ws") - (n - 1))).alias(str(n)) for n in orders])
    totals = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("order"), F.col(str(n)).alias("total")) for n in orders])).alias("x")).select("x.*")
    tasks = ceil((texts.agg(F.sum(F.length(text))).first()[0] or 0) / (6 * TASK_WORDS))  # a word and its space have about six characters

    def found(some: list[int]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), hashed_ngrams(F.col("ws"), n).alias("g")) for n in some])).alias("x")
        return ws.select(each).select("x.n", F.explode("x.g").alias("g")).select("n", "g.a", "g.b")

    short, long = [n for n in orders if n == 1], [n for n in orders if n > 1]
    parts = [found(short).distinct()] if short else []
    if long:
        every = found(long)
        parts.append((every.repartition(tasks * len(long), "n", "a", "b") if tasks > 1 else every).distinct())
    met = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    got = met.groupBy("n").agg(F.count("*").alias("distinct")).join(totals, F.col("n") == F.col("order"))
    ratio = F.col("distinct") / F.col("total")
    return got.select("n", "distinct", "total", ratio.alias("distinct_ratio"), (1 - ratio).alias("repetition"))


def duplicate_ratio(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: N / distinct - 1, at least 0."""
    got = texts.groupBy(F.sha2(text, 256)).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    return got.select(F.greatest(F.lit(0.0), F.try_divide(F.col("n"), F.col("d")) - 1).alias("exact_duplicate_ratio"))


def repetition_rate(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: equal neighbouring words over all words."""
    ws = texts.select(X.words(F.col(text)).alias("ws"))
    same = F.size(F.filter(F.zip_with(F.slice("ws", F.lit(1), F.greatest(F.lit(0), F.size("ws") - 1)), F.slice("ws", F.lit(2), F.greatest(F.lit(0), F.size("ws") - 1)), lambda a, b: a == b), lambda e: e))
    return ws.select(same.alias("r"), F.size("ws").alias("n")).agg(F.sum("r").alias("repeats"), F.sum("n").alias("words")).select("repeats", "words", F.coalesce(F.try_divide(F.col("repeats"), F.col("words")), F.lit(0.0)).alias("repetition_rate"))


def perplexity(losses: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """One row: exp of the token-weighted mean loss."""
    return losses.agg(F.exp(F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("perplexity"))


def sequence_perplexity(steps: DataFrame, sequence: str = "seq", logprob: str = "logprob", mask: str = "mask") -> DataFrame:
    """exp of the mean over sequences of the masked mean negative log-probability."""
    per = steps.groupBy(sequence).agg((F.sum(-F.col(logprob) * F.col(mask)) / F.sum(mask)).alias("nll"))
    return per.agg(F.exp(F.avg("nll")).alias("perplexity"))


def bleu(pairs: DataFrame, candidate: str = "candidate", reference: str = "reference", key: str = "id", most: int = 4) -> DataFrame:
    """(key, bleu): sentence BLEU with one reference; a precision of no match counts as 0.1 over its total (smoothing 1).

    Zero where a side is empty or no single word matches.
    """
    @F.pandas_udf("array<int>")
    def matches(cs: pd.Series, rs: pd.Series) -> pd.Series:
        grams = lambda ws, n: Counter(zip(*(ws[k:] for k in range(n)), strict=False))
        return pd.Series([[sum((grams(c, n) & grams(r, n)).values()) for n in range(1, most + 1)] for c, r in ((list(c), list(r)) for c, r in zip(cs, rs, strict=True))])

    rows = pairs.select(key, X.words(F.col(candidate)).alias("c"), X.words(F.col(reference)).alias("r")).withColumn("m", matches("c", "r"))
    for n in range(1, most + 1):
        rows = rows.withColumn(f"m{n}", F.get("m", F.lit(n - 1))).withColumn(f"t{n}", F.greatest(F.lit(1), F.size("c") - n + 1))
    logs = [F.log(F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(F.lit(0.1) / F.col(f"t{n}"))) for n in range(1, most + 1)]
    brevity = F.when(F.size("c") >= F.size("r"), F.lit(1.0)).otherwise(F.exp(1 - F.size("r") / F.greatest(F.lit(1), F.size("c"))))
    value = F.when((F.size("c") == 0) | (F.size("r") == 0) | (F.col("m1") == 0), F.lit(0.0)).otherwise(brevity * F.exp(sum(logs[1:], logs[0]) / most))
    return rows.select(key, value.alias("bleu"))


def meteor(candidate: Column, reference: Column) -> Column:
    """Exact-match METEOR: unigram F with recall weighted 9 to 1 and the fragmentation penalty 0.5 (chunks / matches) ** 3.

    Words are matched in order of the candidate to the first free place of the reference. Stems and synonyms are not used.
    """
    def one(c: str | None, r: str | None) -> float:
        cs, rs = (c or "").lower().split(), (r or "").lower().split()
        free: dict[str, list[int]] = {}
        for i, w in enumerate(rs):
            free.setdefault(w, []).append(i)
        at = [free[w].pop(0) if free.get(w) else None for w in cs]
        hit = [x for x in at if x is not None]
        if not hit:
            return 0.0
        chunks = sum(1 for k, x in enumerate(at) if x is not None and (k == 0 or at[k - 1] is None or at[k - 1] + 1 != x))
        p, q = len(hit) / len(cs), len(hit) / len(rs)
        return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / len(hit)) ** 3)

    @F.pandas_udf("double")
    def run(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(c, r, strict=True)])

    return run(candidate, reference)


def rule_rewards(response: Column, expected: Column) -> Column:
    """A struct (format, think, correctness): 2 for the whole layout, 1 for the thinking part, 1 for the right answer."""
    layout = response.rlike(r"(?s)^\s*<thinking>.*?</thinking>\s*<answer>.*?</answer>\s*$")
    return F.struct(
        F.when(layout, 2.0).otherwise(0.0).alias("format"),
        F.when(response.rlike(r"(?s)<thinking>.*?</thinking>"), 1.0).otherwise(0.0).alias("think"),
        F.when(X.answer(response) == expected, 1.0).otherwise(0.0).alias("correctness"),
    )


# -- preference and policy arithmetic ----------------------------------------------------------------------------------


def group_advantages(rewards: DataFrame, group: str, reward: str = "reward", scale: bool = True, epsilon: float = 1e-4) -> DataFrame:
    """rewards with `advantage`: reward minus the group's mean, over its sample deviation + epsilon; NaN rewards are 0."""
    w = Window.partitionBy(group)
    r = F.nanvl(F.col(reward), F.lit(0.0))
    centred = r - F.avg(r).over(w)
    return rewards.withColumn("advantage", centred / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + epsilon) if scale else centred)


def token_advantages(rewards: DataFrame, group: str, width: int, reward: str = "reward") -> DataFrame:
    """rewards with `advantages`: (reward - mean) / sample deviation within the group, once for each of `width` tokens; 0 where all are equal."""
    w = Window.partitionBy(group)
    r = F.nanvl(F.col(reward), F.lit(0.0))
    z = F.coalesce(F.try_divide(r - F.avg(r).over(w), F.nullif(F.stddev_samp(r).over(w), F.lit(0.0))), F.lit(0.0))
    return rewards.withColumn("advantages", F.array_repeat(z, width))


def return_advantages(samples: DataFrame, group: str, member: str, gamma: float, rewards: str = "rewards") -> DataFrame:
    """(group, member, t, advantage): the discounted return at each token, less the group's mean at that token, over its sample deviation."""
    each = samples.select(group, member, F.posexplode(discounted(F.col(rewards), gamma)).alias("t", "ret"))
    w = Window.partitionBy(group, "t")
    z = F.try_divide(F.col("ret") - F.avg("ret").over(w), F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0)))
    return each.select(group, member, "t", F.coalesce(z, F.lit(0.0)).alias("advantage"))


def sequence_logprob(steps: DataFrame, sequence: str = "seq", logprob: str = "logprob", mask: str = "mask") -> DataFrame:
    """(sequence, logprob): the masked sum of the steps' log-probabilities."""
    return steps.groupBy(sequence).agg(F.sum(F.col(logprob) * F.col(mask)).alias("logprob"))


def response_logprobs(logprobs: Column, masks: Column, query_length: Column | int) -> Column:
    """The log-probabilities of the tokens after the query, zero where masked. Arrays over query and response."""
    at = F.lit(query_length) if isinstance(query_length, int) else query_length
    rest = lambda a: F.slice(a, at + 1, F.greatest(F.lit(0), F.size(a) - at))
    return F.zip_with(rest(logprobs), rest(masks), lambda p, m: p * m)


def discounted(rewards: Column, gamma: float) -> Column:
    """Returns of an array of rewards: r_t + gamma * what follows."""
    back = F.aggregate(F.reverse(rewards), F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("next")), lambda s, r: F.struct(F.concat(F.array(r + gamma * s["next"]), s["out"]).alias("out"), (r + gamma * s["next"]).alias("next")))
    return back["out"]


def gae(rewards: Column, values: Column, masks: Column, gamma: float = 0.99, lam: float = 0.95) -> Column:
    """Advantages of one sample: delta_t = r m + gamma V_next m - V, A_t = delta_t + gamma lam m A_next. Arrays of doubles."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), masks.alias("m")))
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("a"), F.lit(0.0).alias("v"))

    def step(s: Column, x: Column) -> Column:
        delta = x["r"] * x["m"] + gamma * s["v"] * x["m"] - x["v"]
        a = F.coalesce(delta + gamma * lam * x["m"] * s["a"], F.lit(0.0))
        return F.struct(F.concat(F.array(a), s["out"]).alias("out"), a.alias("a"), F.coalesce(x["v"], F.lit(0.0)).alias("v"))

    return F.aggregate(steps, zero, step, lambda s: s["out"])


def kl_k3(logprob: Column, reference: Column) -> Column:
    d = reference - logprob
    return F.exp(d) - d - 1


def clipped_objective(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * advantage)


def grpo_loss(steps: DataFrame, beta: float = 0.04, low: float = 0.2, high: float = 0.2, sequence: str = "seq") -> DataFrame:
    """One row: mean over sequences of the masked mean of -clipped + beta KL. steps: logprob, old_logprob, ref_logprob, advantage, mask."""
    ratio = F.exp(F.col("logprob") - F.col("old_logprob"))
    each = -clipped_objective(ratio, F.col("advantage"), low, high) + beta * kl_k3(F.col("logprob"), F.col("ref_logprob"))
    per = steps.groupBy(sequence).agg((F.sum(each * F.col("mask")) / F.sum("mask")).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"))


def ppo_loss(steps: DataFrame, clip: float = 0.2, kl_coef: float = 0.1, entropy_coef: float = 0.01) -> DataFrame:
    """One row: policy loss, KL penalty (mean over sequences of the sum), entropy term and their total."""
    ratio = F.exp(F.col("logprob") - F.col("old_logprob"))
    policy = F.avg(-clipped_objective(ratio, F.col("advantage"), clip, clip)).alias("policy_loss")
    entropy = F.avg(-F.exp("logprob") * F.col("logprob")).alias("entropy")
    kl = steps.groupBy("seq").agg(F.sum(F.col("logprob") - F.col("ref_logprob")).alias("kl")).agg(F.avg("kl").alias("kl"))
    both = steps.agg(policy, entropy).join(F.broadcast(kl), how="full")  # one row each
    return both.select("policy_loss", "entropy", "kl", (F.col("policy_loss") + kl_coef * F.col("kl") - entropy_coef * F.col("entropy")).alias("loss"))


def dpo_loss(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row: -mean log sigmoid(beta (policy margin - reference margin)) and the share of positive differences."""
    logit = (F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected"))
    x = beta * logit
    # log sigmoid without overflow
    ls = F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    return pairs.agg((-F.avg(ls)).alias("loss"), F.avg((logit > 0).cast("double")).alias("win_rate"))


def kl_controller(kls: Column, start: float, target: float, rate: float) -> Column:
    """The coefficient after a sequence of observed KLs: max(0, c + rate (kl - target)) step by step."""
    return F.aggregate(kls, F.lit(float(start)), lambda c, k: F.coalesce(F.greatest(F.lit(0.0), c + rate * (k - target)), F.lit(0.0)))


def kl_controllers(rows: DataFrame, by: str, order: str, kl: str, start: float, target: float, rate: float) -> DataFrame:
    """(by, coef): kl_controller for every key over its rows in order, without gathering them.

    With steps s = rate (kl - target) and their running sums S, the coefficient that never falls below 0 is
    S + max(start, -min S so far): one window with a running sum, then one aggregate.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(by, order, F.sum(F.lit(rate) * (F.col(kl) - F.lit(target))).over(w).alias("s"))
    ends = sums.groupBy(by).agg(F.max_by("s", order).alias("last"), F.min("s").alias("low"))
    return ends.select(by, (F.col("last") + F.greatest(F.lit(float(start)), -F.col("low"))).alias("coef"))


def count_buffers(rows: DataFrame, size: int, order: str, by: str) -> DataFrame:
    """rows with `buffer`: every `size` rows of a key, in order, fill one."""
    return rows.withColumn("buffer", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("bigint"))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """logits[index] - logsumexp(logits), index from 0."""
    top = F.array_max(logits)
    return F.get(logits, index) - (F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top)


def until_eos(tokens: Column, eos: int) -> Column:
    """Tokens up to and with the first end token; all if there is none."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens)


def padded(tokens: Column, width: Column | int, pad: int = 0) -> Column:
    """Cut or right-padded to a width."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.slice(tokens, F.lit(1), w), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), w - F.size(tokens))))


def best(rows: DataFrame, score: str, what: str) -> DataFrame:
    """One row: `what` of the highest score (ties: the smallest), and the score."""
    return rows.agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(what)).alias("w"))).alias("b")).select((-F.col("b.w")).alias(what), F.col("b.s").alias(score))


def next_token_logprobs(steps: DataFrame, keep: int, temperature: float = 1.0) -> DataFrame:
    """(seq, t, logprob): of rows (seq, t, token, logits) the log-probability of the next token, the last `keep` of each sequence."""
    w = Window.partitionBy("seq").orderBy("t")
    shifted = steps.select("seq", "t", F.transform("logits", lambda x: x.cast("double") / temperature).alias("l"), F.lead("token").over(w).alias("next"))
    last = Window.partitionBy("seq").orderBy(F.desc("t"))
    scored = shifted.where(F.col("next").isNotNull()).withColumn("r", F.row_number().over(last)).where(F.col("r") <= keep)
    return scored.select("seq", "t", log_softmax_at(F.col("l"), F.col("next")).alias("logprob"))


def composite_reward(text: Column, query: Column, tokens: Column, least: int = 32) -> Column:
    """0.4 coherence + 0.4 relevance + 0.2 engagement, scaled down below a number of tokens."""
    return (0.4 * X.coherence(text) + 0.4 * X.relevance(text, query) + 0.2 * X.engagement(text)) * F.least(tokens / least, F.lit(1.0))


def reference_free_loss(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row of (chosen_loss, rejected_loss) pairs: -mean log sigmoid(beta (rejected - chosen)), and how often chosen is better."""
    x = beta * (F.col("rejected_loss") - F.col("chosen_loss"))
    ls = F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    return pairs.agg((-F.avg(ls)).alias("loss"), F.avg((F.col("rejected_loss") > F.col("chosen_loss")).cast("double")).alias("preference_accuracy"))


def collated(rows: DataFrame, batch: str, tokens: str, pad: str = "<pad>") -> DataFrame:
    """rows with `tokens` padded to the longest of their batch."""
    width = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    return rows.withColumn("width", width).withColumn(tokens, F.concat(F.col(tokens), F.array_repeat(F.lit(pad), F.col("width") - F.size(tokens)))).drop("width")


def repeated(rows: DataFrame, n: int) -> DataFrame:
    """Every row n times in a row, with `copy` from 0."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by the smallest md5 of key and seed: the same rows in every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def joined_bigram_diversity(texts: DataFrame, order: str, text: str = "text") -> DataFrame:
    """One row (distinct_1, distinct_2): words and word pairs over all texts end to end, so pairs cross their borders.

    The border pairs come from each text's first and last word; only these are ordered across texts.
    """
    ws = texts.select(order, X.words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    one = ws.select(F.explode("ws").alias("g")).groupBy("g").agg(F.count("*").alias("c")).agg((F.count("*") / F.sum("c")).alias("distinct_1"))
    inner = ws.select(F.explode(ngrams(F.col("ws"), 2)).alias("g"))
    ends = ws.select(order, F.get("ws", F.lit(0)).alias("first"), F.element_at("ws", -1).alias("last"))
    border = preceded(ends, order, "last", "before").where(F.col("before").isNotNull()).select(F.array("before", "first").alias("g"))
    two = inner.union(border).groupBy("g").agg(F.count("*").alias("c")).agg((F.count("*") / F.sum("c")).alias("distinct_2"))
    return one.join(F.broadcast(two), how="full")  # one row each


def corpus_report(texts: DataFrame, losses: DataFrame, text: str = "text") -> DataFrame:
    """One row: perplexity of given losses, distinct ratios of orders 1 to 4 and the share of exact duplicates."""
    d = diversity(texts, text=text).groupBy().pivot("n", [1, 2, 3, 4]).agg(F.first("distinct_ratio"))
    d = d.select(*[F.col(str(n)).alias(f"distinct_{n}") for n in range(1, 5)])
    return perplexity(losses).join(F.broadcast(d), how="full").join(F.broadcast(duplicate_ratio(texts, text)), how="full")
