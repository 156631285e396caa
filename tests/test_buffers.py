"""The streaming buffers against the batch query: micro-batches, a restart from the checkpoint, silent keys."""

from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.streaming import buffers as S


def test_micro_batches_and_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.timestamp_millis(1_700_000_000_000 + F.col("event_id") * 1000).alias("ts"))
    n = events.count()
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    stream = lambda: S.count_buffers(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(land), 4, "event_id", "user_id", "ts", "10 days")
    cuts = [0, n // 5, n // 2, n // 2 + 3, n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        events.where(f"event_id > {a - (k == 0)} and event_id <= {b}" if k else f"event_id <= {b}").coalesce(1).write.mode("append").parquet(land)
        if k in (1, 3):  # two micro-batches each; the second run starts from the checkpoint of the first
            S.run_buffers(stream(), out, state)
    full = M.count_buffers(events, 4, "event_id", "user_id").groupBy("user_id", "buffer").agg(F.sort_array(F.collect_list("event_id")).alias("members")).where(F.size("members") == 4)
    want = sorted((r["user_id"], r["buffer"], r["members"]) for r in full.collect())
    got = sorted((r["user_id"], r["buffer"], r["members"]) for r in spark.read.parquet(out).where("is_full").collect())
    assert want and got == want
    # silence: an event far ahead moves the watermark, and the rests of all other keys come out
    last = spark.createDataFrame([(10**6, -1)], "event_id long, user_id long").withColumn("ts", F.timestamp_millis(F.lit(1_900_000_000_000)))
    for k in range(2):
        last.withColumn("event_id", F.col("event_id") + k).write.mode("append").parquet(land)
        S.run_buffers(stream(), out, state)
    rest = M.count_buffers(events, 4, "event_id", "user_id").groupBy("user_id", "buffer").agg(F.sort_array(F.collect_list("event_id")).alias("members")).where(F.size("members") < 4)
    got = sorted((r["user_id"], r["buffer"], r["members"]) for r in spark.read.parquet(out).where("not is_full").collect())
    assert got == sorted((r["user_id"], r["buffer"], r["members"]) for r in rest.collect())


def test_text_keys_and_missing_values(spark, tmp_path):
    land, out, state = (str(tmp_path / x) for x in ("land", "out", "state"))
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (3, "a"), (4, "b")], "id long, k string").withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_000)))
    rows.write.parquet(land)
    S.run_buffers(S.count_buffers(spark.readStream.schema(rows.schema).parquet(land), 2, "id", "k", "at"), out, state)
    assert [tuple(r) for r in spark.read.parquet(out).select("k", "buffer", "is_full", "members").collect()] == [("a", 0, True, [1, 3])]
