"""Timestamps as microseconds, for both timestamp types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch; a zone-less timestamp counts as UTC, so
    the session's time zone never changes a difference."""
    ts = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(ts)
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * 60_000_000
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return day + clock + seconds
