"""Weekly counts of an event stream; late rows count until the watermark passes their week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, key: str, t: str = "ts", late: str = "7 days") -> DataFrame:
    """(key, week_start, cases) of a batch or streaming frame with event times."""
    timed = events.withColumn(t, F.col(t).cast("timestamp"))
    timed = timed.withWatermark(t, late) if events.isStreaming else timed
    # Spark's windows count from the epoch, a Thursday; four days later weeks start on Monday.
    return timed.groupBy(key, F.window(t, "7 days", None, "4 days").alias("w")).agg(F.count("*").alias("cases")).select(key, F.to_date("w.start").alias("week_start"), "cases")
