"""Streaming: buffers of a fixed number of rows for every key, kept in state between micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

COUNT = T.StructType([T.StructField("buffers", T.LongType())])
OPEN = T.StructType([T.StructField("id", T.LongType()), T.StructField("ms", T.LongType())])


class CountBuffers(StatefulProcessor):
    """State of a key: how many buffers it has filled, and the rows of the open one, fewer than `size`.

    A full buffer is emitted at once, a part of one when event time is `idle` ms past its last row (timer); a row that
    comes later opens the next buffer. Rows of one micro-batch are taken in the order of their ids.
    """

    def __init__(self, size: int, idle: int, kind: str):
        self.size, self.idle, self.kind = size, idle, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", COUNT)
        self.open = handle.getListState("open", OPEN)

    def _frame(self, key, done: list[tuple[int, bool, list[int]]]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key] * len(done), dtype="object" if self.kind == "string" else "int64"), "buffer": pd.Series([b for b, _, _ in done], dtype="int64"), "is_full": pd.Series([f for _, f, _ in done], dtype="bool"), "members": pd.Series([m for _, _, m in done], dtype="object")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(i), int(t)) for part in rows for i, t in zip(part["id"], part["ms"], strict=True))
        held = [(int(r[0]), int(r[1])) for r in self.open.get()]
        filled = int(self.count.get()[0]) if self.count.exists() else 0
        done = []
        for row in new:
            held.append(row)
            if len(held) == self.size:
                done.append((filled, True, [i for i, _ in held]))
                filled, held = filled + 1, []
        self.count.update((filled,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.open.put(held)
            self.handle.registerTimer(max(t for _, t in held) + self.idle)
        else:
            self.open.clear()
        yield self._frame(key[0], done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [int(r[0]) for r in self.open.get()]
        filled = int(self.count.get()[0]) if self.count.exists() else 0
        self.open.clear()
        self.count.update((filled + bool(held),))
        yield self._frame(key[0], [(filled, False, held)] if held else [])

    def close(self) -> None:
        pass


def count_buffers(stream: DataFrame, size: int, order: str, by: str, time: str, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """(by, buffer, is_full, members): every `size` rows of a key fill a buffer; members are the rows' ids (`order`).

    Rows without key or id are left out. The rest of a key that has been silent for `idle` of event time is emitted as a
    part of a buffer. The state of a key is a count and fewer than `size` rows.
    """
    kind = "string" if dict(stream.dtypes)[by] == "string" else "long"
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.withWatermark(time, delay).where(F.col(by).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(by).cast(kind).alias("key"), F.col(order).cast("long").alias("id"), F.unix_millis(F.col(time)).alias("ms"), F.col(time).alias("at"))
    out = f"key {kind}, buffer long, is_full boolean, members array<long>"
    made = rows.groupBy("key").transformWithStateInPandas(CountBuffers(size, ms, kind), out, "Append", "EventTime")
    return made.withColumnRenamed("key", by)


def run_buffers(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is and stop; the sink is Parquet. A later call with the same checkpoint goes on where this one stopped."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)  # the state of transformWithState needs this store
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)
