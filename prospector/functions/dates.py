"""Ages and the bonuses that hang on them; the moment is always given, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

DAY_US = 86_400_000_000.0
MONTH_DAYS = 30.44


def age_days(at: Column | str, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(at).cast("timestamp"))) / DAY_US


def age_months(at: Column | str, as_of: Column) -> Column:
    return age_days(at, as_of) / MONTH_DAYS


def recency_bonus(at: Column | str, as_of: Column) -> Column:
    days = age_days(at, as_of)
    return F.when(days <= 30, 2).when(days <= 180, 1).when(days > 365, -2).otherwise(0)


def compact_date(c: Column | str) -> Column:
    """yyyymmdd as a date; zeros and nonsense as null."""
    return F.to_date(F.try_to_timestamp(F.nullif(col(c), F.lit("00000000")), F.lit("yyyyMMdd")))
