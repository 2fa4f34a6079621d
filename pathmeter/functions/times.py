"""UTC wall-clock timestamps and instants, whatever the session's time zone.

Stored times carry no zone and mean UTC; watermarks need instants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less UTC time.

    Built from its fields: the difference function would go through the
    session's zone and its clock changes.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    minutes = F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def instant(ts: Column | str) -> Column:
    """The instant a zone-less UTC time stands for."""
    return F.timestamp_micros(micros(ts))


def from_micros(value: Column | str) -> Column:
    """Zone-less UTC time of microseconds since the epoch."""
    value = F.col(value) if isinstance(value, str) else value
    # Added in parts, since the function takes 32-bit amounts.
    day = F.lit(86_400_000_000)
    of_day = F.pmod(value, day)
    rest = F.pmod(value, F.lit(1_000_000))
    days = ((value - of_day) / day).cast("int")
    seconds = ((of_day - rest) / 1_000_000).cast("int")
    whole = F.timestamp_add("SECOND", seconds, F.timestamp_add("DAY", days, _epoch()))
    return F.timestamp_add("MICROSECOND", rest.cast("int"), whole)


def plain(ts: Column | str) -> Column:
    """Zone-less UTC time of an instant."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return from_micros(F.unix_micros(ts))
