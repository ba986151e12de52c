"""Streaming forms of job expiry and single use. Per-row operators (columns, cells) apply to a stream unchanged."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilcraft.operators.jobs import TTL_SECONDS

#: Timers need this state store; Spark's default one has none.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Start queries with timers inside; the session's own state store setting comes back at the end."""
    before = spark.conf.get(_STORE_SETTING, None)
    spark.conf.set(_STORE_SETTING, TIMER_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE_SETTING, before) if before else spark.conf.unset(_STORE_SETTING)


def _millis(moment: dt.datetime) -> int:
    """Whole milliseconds since 1970; a moment without a zone is local time, as Spark hands it over."""
    return int(moment.timestamp() * 1000)


class Expiry(StatefulProcessor):
    """One live job per token and a timer for the end of its life."""

    def __init__(self, created_type: T.DataType, ttl_seconds: int):
        self.created_type, self.ttl = created_type, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", T.StructType([T.StructField("created_at", self.created_type)]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        made = max(row["created_at"] for row in rows)
        held = self.live.get() if self.live.exists() else None
        if held is None or held[0] < made:  # a token that is issued again starts a new life
            self.live.update((made,))
            self.handle.registerTimer(_millis(made) + self.ttl + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.live.get() if self.live.exists() else None
        if held is None or _millis(held[0]) + self.ttl + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return  # the timer of an earlier life
        self.live.clear()
        yield Row(token=key[0], created_at=held[0])


def expired_jobs_stream(jobs: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Jobs of a stream (token, created_at), each once the clock is past its lifetime: ``created_at < now - ttl``.

    The clock is the time of the micro-batch, so the trigger's interval is the sweep interval, and the last jobs of a stream
    expire without newer ones. State holds one row per live job and goes with it. Jobs without a token or time never live.
    Start the query within :func:`timer_store`.
    """
    known = jobs.where("token IS NOT NULL AND created_at IS NOT NULL").select("token", "created_at")
    shape = T.StructType([known.schema["token"], known.schema["created_at"]])
    return known.groupBy("token").transformWithState(Expiry(known.schema["created_at"].dataType, ttl_seconds), shape, "Append", "ProcessingTime")


def _met(jobs: DataFrame, redemptions: DataFrame, ttl_seconds: int, how: str) -> DataFrame:
    """Redemptions with the job that they find alive; both sides leave the state when the other's watermark has passed them."""
    issued = jobs.select(F.col("token").alias("_issued"), "created_at").withWatermark("created_at", f"{ttl_seconds} seconds")
    used = redemptions.withWatermark("redeemed_at", f"{ttl_seconds} seconds")
    alive = F.col("redeemed_at").between(F.col("created_at"), F.col("created_at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    return used.join(issued, (F.col("token") == F.col("_issued")) & alive, how)


def first_redemptions_stream(jobs: DataFrame, redemptions: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The redemption (token, redeemed_at, ...) that is served of every job (token, created_at), as it arrives.

    A redemption meets the job of its token if the job was issued and its lifetime is not over; the first to arrive takes
    it away. Unknown tokens, expired jobs and second uses are refused, and so are redemptions that arrive later than their
    watermark. A token is remembered for the lifetime after its first use; by then the job is over.
    """
    served = _met(jobs, redemptions, ttl_seconds, "inner").drop("_issued", "created_at")  # one event time for what follows
    return served.dropDuplicatesWithinWatermark(["token"])


def refused_redemptions_stream(jobs: DataFrame, redemptions: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The redemptions whose token no job has, or whose job is over; each once no job of its time can follow."""
    return _met(jobs, redemptions, ttl_seconds, "leftOuter").where("_issued IS NULL").drop("_issued", "created_at")


def write_available(stream: DataFrame, path: str, checkpoint: str, sweep: bool = False) -> StreamingQuery:
    """Process what is there into Parquet and stop.

    A query with timers of the clock always has another batch to run; ``sweep`` makes it one batch, a single sweep.
    """
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**({"once": True} if sweep else {"availableNow": True}))
        .start()
    )
