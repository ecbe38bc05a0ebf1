"""Times as seconds, as text and as ages. What stands for now is always given, never read from the machine."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_age(df: DataFrame, column: str, now: datetime) -> DataFrame:
    """Add epoch (seconds since 1970, rounded down), shown ('2026-01-31 12:00:00', session time zone) and age (seconds until `now`, UTC if it names no zone); null times give nulls."""
    at = F.col(column).cast("timestamp")
    epoch = F.floor(F.unix_micros(at) / 1_000_000).cast("long")
    clock = int((now if now.tzinfo else now.replace(tzinfo=UTC)).timestamp())
    return df.withColumn("epoch", epoch).withColumn("shown", F.date_format(at, "yyyy-MM-dd HH:mm:ss")).withColumn("age", F.lit(clock) - epoch)
