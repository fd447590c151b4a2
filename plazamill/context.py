"""The clock and the session settings that every result depends on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    """"Today" and "now" as arguments: no operator reads the wall clock."""

    today: date
    now: datetime

    @property
    def day(self) -> Column:
        return F.lit(self.today)

    @property
    def instant(self) -> Column:
        return F.to_timestamp(F.lit(self.now.strftime("%Y-%m-%d %H:%M:%S")))


#: The clocks of the registered queries: postings adapted from orders, events adapted from events.
OFFERS = Clock(date(1998, 6, 1), datetime(1998, 6, 1, 12, 0, 0))
EVENTS = Clock(date(2024, 1, 31), datetime(2024, 1, 31, 0, 0, 0))


def session(name: str = "plazamill", master: str | None = None) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive execution, skew joins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
