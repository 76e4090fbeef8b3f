"""Circuit breakers as a stream-stream join of calls and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_circuits(errors: DataFrame, calls: DataFrame, provider: str, time: str, row: str, cooldown: int = 300, late: str = "10 minutes") -> DataFrame:
    """row, disabled: whether a call's provider had a quota error within the cooldown before it; see operators.jobs.

    Time is cut into buckets as long as the cooldown, and an error goes to its own and the next one, so that calls and
    errors meet by (provider, bucket) and a busy provider is spread. Both sides are held for the cooldown and `late`.
    Errors of one second are one where they can be, so that a burst of them does not multiply a call's rows; of those that
    are left the call's first is told. A call is told that nothing stopped when the watermark has passed it: rows without a
    provider are heartbeats, which move it where a side is silent.
    """
    bucket = F.floor(F.unix_seconds(time) / cooldown)
    stamped = errors.withWatermark(time, late).select(F.col(provider).alias("_p"), F.col(time).alias("_t"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    failed = stamped.dropDuplicatesWithinWatermark(["_p", "_t", "_b"])
    asked = calls.withWatermark(time, late).select(F.col(provider).alias("_q"), F.col(time).alias("_at"), bucket.alias("_c"), F.col(row).alias("_row"))
    within = (F.col("_q") == F.col("_p")) & (F.col("_c") == F.col("_b")) & (F.col("_t") <= F.col("_at")) & (F.col("_at") < F.col("_t") + F.make_dt_interval(secs=F.lit(cooldown)))
    met = asked.join(failed, within, "left_outer").select("_q", "_row", "_at", F.col("_p").isNotNull().alias("disabled"))
    # heartbeats go last of all: a filter before would be pushed below the watermark, which they have to move
    return met.dropDuplicatesWithinWatermark(["_q", "_row"]).where(F.col("_q").isNotNull()).select(F.col("_row").alias(row), "disabled")
