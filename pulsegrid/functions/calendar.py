"""Time expressions: day numbers, days, slots, calendar fields, coercing parses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Day number of 1970-01-01 in the proleptic day count used by matrix files, and microseconds per day.
EPOCH_DAY_NUMBER = 719529
MICROS_PER_DAY = 86_400_000_000
MICROS_PER_MINUTE = 60_000_000

CALENDAR_FIELDS = ("dow", "hour", "month")


def day_number_to_timestamp(column: Column | str) -> Column:
    """Day number with a fractional part to a zone-free timestamp, rounded to the microsecond."""
    value = F.col(column) if isinstance(column, str) else column
    micros = F.round((value - EPOCH_DAY_NUMBER) * MICROS_PER_DAY).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def day_of(ts: str = "ts") -> Column:
    return F.to_date(F.col(ts))


def slot_in_day(ts: str = "ts", slot_minutes: float = 15) -> Column:
    """Index of the slot inside the day; 0..95 for slots of 15 minutes."""
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    return F.floor(minute_of_day / F.lit(slot_minutes)).cast("int")


def calendar_field(name: str, ts: str = "ts") -> Column:
    """``dow`` counts from Monday = 0."""
    builders = {"dow": F.weekday, "hour": F.hour, "month": F.month}
    if name not in builders:
        raise ValueError(f"unknown calendar field {name!r}; choose from {CALENDAR_FIELDS}")
    return builders[name](F.col(ts)).cast("int")


def calendar_fields(which: Sequence[str], ts: str = "ts") -> dict[str, Column]:
    return {name: calendar_field(name, ts) for name in which}


def minutes_between(earlier: Column, later: Column) -> Column:
    """Difference of zone-free times: no session zone and no clock change enters it."""
    gap = later - earlier
    part = lambda name: F.extract(F.lit(name), gap)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    micros = minutes * MICROS_PER_MINUTE + (part("SECOND") * 1_000_000).cast("bigint")
    return micros / F.lit(float(MICROS_PER_MINUTE))


def parse_timestamp(column: Column | str) -> Column:
    """Text to timestamp; text that does not parse becomes NULL."""
    value = F.col(column) if isinstance(column, str) else column
    return value.cast("string").try_cast("timestamp_ntz")


def parse_number(column: Column | str) -> Column:
    """Anything to double; what does not parse, and NaN, becomes NULL."""
    value = F.col(column) if isinstance(column, str) else column
    return null_if_nan(value.try_cast("double"))


def null_if_nan(column: Column) -> Column:
    """The engine knows one missing value, NULL: aggregates skip it, while NaN would poison them."""
    return F.when(~F.isnan(column), column)


def slots_per_day(slot_minutes: float) -> int:
    return int(round(24 * 60 / float(slot_minutes)))
