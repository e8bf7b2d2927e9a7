"""Time parsing and rendering, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time layouts of the records.
EVENT_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}$"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
SECONDS = "yyyy-MM-dd HH:mm:ss"
RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"

# Nanoseconds per duration unit.
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "\u00b5s": 1_000,
    "\u03bcs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
DAY_NANOS = 24 * UNIT_NANOS["h"]


def parse_event_time(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss,SSS`` to a timestamp without zone; NULL when malformed."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.when(F.rlike(text, F.lit(EVENT_TIME)), dotted.try_cast("timestamp_ntz"))


def iso_millis(ts: Column) -> Column:
    """Millisecond text with a literal Z and no zone shift."""
    return F.date_format(ts, ISO_MILLIS)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp read as UTC."""
    seconds = F.extract(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000
        + F.hour(ts) * 3_600_000
        + F.minute(ts) * 60_000
        + F.floor(seconds * 1000).cast("bigint")
    )


def display_time(millis: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss`` in the session zone."""
    return F.date_format(F.timestamp_millis(millis), SECONDS)


def render_time(text: Column) -> Column:
    """A zoned time text as its own wall clock; text that is not one stays as it is."""
    day = F.regexp_extract(text, RFC3339, 1)
    clock = F.regexp_extract(text, RFC3339, 2)
    wall = F.concat(day, F.lit(" "), clock)
    return F.when(F.rlike(text, F.lit(RFC3339)) & wall.try_cast("timestamp_ntz").isNotNull(), wall).otherwise(text)


_UNITS = "ns|us|\u00b5s|\u03bcs|ms|s|m|h"
_QUANTITY = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_CLOCK = rf"^[+-]?(?:0|(?:{_QUANTITY}(?:{_UNITS}))+)$"


def _clock_nanos(text: Column) -> Column:
    """Sum of the quantities of ``5h20m`` style text in nanoseconds; NULL when malformed or beyond bigint."""
    part = rf"({_QUANTITY})({_UNITS})"
    amounts = F.regexp_extract_all(text, F.lit(part), 1)
    units = F.regexp_extract_all(text, F.lit(part), 2)
    nanos = F.create_map(*[F.lit(x) for pair in UNIT_NANOS.items() for x in pair])
    products = F.zip_with(
        amounts,
        units,
        # 20 digits before the point hold every bigint of nanoseconds, and 9 behind it an hour's.
        lambda a, u: F.try_multiply(a.try_cast("decimal(29,9)"), nanos[u].cast("decimal(14,0)")).try_cast("bigint"),
    )
    total = F.aggregate(products, F.lit(0).cast("bigint"), lambda x, y: F.try_add(x, y))
    signed = F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)
    return F.when(F.rlike(text, F.lit(_CLOCK)), signed)


def parse_duration(text: Column) -> Column:
    """Duration text to nanoseconds: ``1d5h20m``, ``5h20m``, or a bare count of nanoseconds.

    A malformed number of days reads as 0 and a malformed tail behind the days
    is ignored; other malformed text gives NULL.
    """
    text = F.trim(text)
    cut = F.instr(text, "d")
    head = F.substring(text, F.lit(1), cut - 1)
    days = F.when(F.rlike(head, F.lit(r"^[+-]?[0-9]+$")), head.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    tail = F.coalesce(_clock_nanos(F.substring(text, cut + 1, F.length(text))), F.lit(0))
    bare = F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+$")), text.try_cast("bigint"))
    return (
        F.when(F.rlike(text, F.lit(_CLOCK)), _clock_nanos(text))
        .when(cut > 0, F.try_add(F.try_multiply(days, F.lit(DAY_NANOS)), tail))
        .otherwise(bare)
    )
