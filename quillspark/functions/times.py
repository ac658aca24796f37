"""Times as numbers, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a time with or without a zone; one without is taken for UTC."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_millis(c.cast("timestamp"))
    minutes = (F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000 + F.floor(F.date_part(F.lit("SECOND"), c) * 1000).cast("bigint")
