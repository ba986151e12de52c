"""Expiry and single use of download jobs.

``jobs``: token, created_at (timestamp).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
TTL_SECONDS = 15 * 60
SWEEP_SECONDS = 60


def expired_jobs(jobs: DataFrame, as_of: dt.datetime | str | Column) -> DataFrame:
    """Jobs older than the lifetime at ``as_of``; one of exactly that age still lives."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    now = now.cast(jobs.schema["created_at"].dataType)
    return jobs.where(F.col("created_at") < now - F.expr(f"INTERVAL {TTL_SECONDS} SECONDS"))


def first_redemptions(redemptions: DataFrame) -> DataFrame:
    """The redemption that succeeds for each token: the earliest, by time and then id.

    An aggregate, not a window: a token redeemed very often is reduced before the shuffle.
    """
    when = F.struct("redeemed_at", "redemption_id")
    return (
        redemptions.groupBy("token")
        .agg(F.min(when).alias("_first"), F.count(F.lit(1)).alias("attempts"))
        .select(
            "token",
            F.col("_first.redeemed_at").alias("redeemed_at"),
            F.col("_first.redemption_id").alias("redemption_id"),
            (F.col("attempts") - 1).alias("refused"),
        )
    )
