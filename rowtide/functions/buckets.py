"""Names of time buckets, as column expressions and for one moment on the driver."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _week(t: Column) -> Column:
    """Week of the year, Mondays first, 00 before the first Monday."""
    return F.lpad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("string"), 2, "0")


@dataclass(frozen=True)
class Bucket:
    cyclic: bool
    lookback: int
    step: dt.timedelta
    text: Callable[[Column], Column]
    name_of: Callable[[dt.datetime], str]


def _formatted(pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.date_format(t, pattern)


_DAY, _HOUR, _MINUTE = dt.timedelta(days=1), dt.timedelta(hours=1), dt.timedelta(minutes=1)

#: The ten bucket formats and their lookbacks.  MONTH has a two-digit year
#: followed by the letters yyy; writers and readers share it.
BUCKETS: dict[str, Bucket] = {
    "DAY": Bucket(False, 60, _DAY, _formatted("yyyy-MM-dd"), lambda t: t.strftime("%Y-%m-%d")),
    "WEEK": Bucket(False, 60, _DAY, lambda t: F.concat(F.date_format(t, "yyyy"), F.lit("-"), _week(t)), lambda t: t.strftime("%Y-%W")),
    "MONTH": Bucket(False, 60, _DAY, lambda t: F.concat(F.date_format(t, "yy"), F.lit("yyy-"), F.date_format(t, "MM")), lambda t: t.strftime("%yyyy-%m")),
    "YEAR": Bucket(False, 60, _DAY, _formatted("yyyy"), lambda t: t.strftime("%Y")),
    "MINUTE_OF_HOUR": Bucket(True, 45, _MINUTE, _formatted("mm"), lambda t: t.strftime("%M")),
    "HOUR_OF_DAY": Bucket(True, 60, _HOUR, _formatted("HH"), lambda t: t.strftime("%H")),
    "DAY_OF_WEEK": Bucket(True, 60, _DAY, lambda t: (F.weekday(t) + 1).cast("string"), lambda t: str(t.isoweekday())),
    "DAY_OF_MONTH": Bucket(True, 60, _DAY, _formatted("dd"), lambda t: t.strftime("%d")),
    "WEEK_OF_YEAR": Bucket(True, 60, _DAY, _week, lambda t: t.strftime("%W")),
    "DAY_OF_YEAR": Bucket(True, 60, _DAY, _formatted("DDD"), lambda t: t.strftime("%j")),
}


def bucket_text(at: Column, bucket: str) -> Column:
    return BUCKETS[bucket].text(at)


def hashed(name: str) -> str:
    return base64.b64encode(hashlib.sha512(name.encode()).digest()).decode()


class CachedShardId:
    """A writer's current shard value, computed again only when its bucket has passed."""

    def __init__(self, bucket: str, encoded: bool = True):
        self.bucket, self.encoded, self.name = BUCKETS[bucket], encoded, None

    def should_refresh(self, now: dt.datetime) -> bool:
        return self.name != self.bucket.name_of(now)

    def value(self, now: dt.datetime) -> str:
        if self.should_refresh(now):
            self.name = self.bucket.name_of(now)
        return hashed(self.name) if self.encoded else self.name
