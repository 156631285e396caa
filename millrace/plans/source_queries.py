"""Queries over sources and streams: what is written to the shared folder is read back by the source under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.plans.catalog import query, table
from millrace.sources import files
from millrace.storage import shared_dir
from millrace.streaming import buffers, dedup


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


@query("json_records", "SELECT doc_id, text FROM documents")
def json_records(spark, sf_dir):
    path = _fresh(spark, "records") + ".jsonl"
    table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    got = files.records(spark, path)
    return got.select("doc_id", F.col(files.text_field(got)).alias("text"))


@query("text_lines", "SELECT md5(line) AS md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def text_lines(spark, sf_dir):
    path = _fresh(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return files.lines(spark, path).groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"))


@query("preference_frames", "SELECT turn, concat('[INST] ', text, ' [/INST] ', role) AS chosen_text FROM conversations")
def preference_frames(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("turn", F.col("text").alias("prompt"), F.col("role").alias("chosen"), F.lit("no").alias("rejected"))
    framed = c.select("turn", F.struct("prompt", "chosen", "rejected").alias("p"))
    p = F.concat(F.lit("[INST] "), "p.prompt", F.lit(" [/INST] "), "p.chosen")
    return framed.select("turn", p.alias("chosen_text"))


@query("stream_exact_dedup", "SELECT DISTINCT sha256(text) AS digest FROM documents")
def stream_exact_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text")
    landed = _fresh(spark, "landing")
    rows.write.parquet(landed)
    timed = spark.readStream.schema(rows.schema).parquet(landed).withColumn("ts", F.timestamp_seconds(F.lit(1_000_000)))
    out, state = _fresh(spark, "stream"), _fresh(spark, "stream-state")
    dedup.run_available(dedup.stream_dedup(timed, "ts", "text").select("digest"), out, state)
    return spark.read.parquet(out)


@query(
    "stream_count_buffer",
    """SELECT user_id, buffer, array_to_string(list(event_id ORDER BY event_id), ',') AS members FROM (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS buffer FROM events)
       GROUP BY user_id, buffer HAVING count(*) = 16""",
)
def stream_count_buffer(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    landed, out, state = (_fresh(spark, x) for x in ("landing", "stream", "stream-state"))
    rows.write.parquet(landed)
    buffers.run_buffers(buffers.count_buffers(spark.readStream.schema(rows.schema).parquet(landed), 16, "event_id", "user_id", "at", "365 days"), out, state)
    return spark.read.parquet(out).where("is_full").select("user_id", "buffer", F.array_join("members", ",").alias("members"))
