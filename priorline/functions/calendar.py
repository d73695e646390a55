"""Time parsing, calendar parts and the holiday rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date and time-of-day notations, tried in order.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd",
    "M/d/yyyy", "M/d/yyyy H:mm", "d-MMM-yyyy", "MMM d yyyy", "MMMM d, yyyy",
]
# Two-digit years: 69 to 99 belong to the 1900s.
SHORT_YEAR_FORMATS = ["d-MMM-yy", "M/d/yy"]
TIME_FORMATS = [
    "H:mm", "H:mm:ss", "H:mm:ss.SSS", "h:mm a", "h:mm:ss a", "h a",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
]

SECONDS_PER_DAY = 86_400
MICROS_PER_DAY = SECONDS_PER_DAY * 1_000_000


def _first_parse(text: Column, formats: Sequence[str]) -> Column:
    # The zone of the session cancels out: the text is read and written back in the same zone.
    return F.coalesce(
        *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    seconds = (
        F.unix_date(ts.cast("date")).cast("bigint") * SECONDS_PER_DAY
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    )
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + fraction


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Zone-less timestamp of a date text, NULL when no notation fits."""
    trimmed = F.trim(text)
    short = F.when(trimmed.rlike("[-/][0-9]{2}$"), _first_parse(trimmed, SHORT_YEAR_FORMATS))
    century = F.when(F.year(short) > 2068, F.make_ym_interval(F.lit(100))).otherwise(F.make_ym_interval(F.lit(0)))
    return F.coalesce(short - century, _first_parse(trimmed, formats))


def parse_time_seconds(text: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Second of the day of a time text.

    A number in [0, 1) is a fraction of a day. Text without a digit, and text no notation
    fits, gives NULL.
    """
    trimmed = F.trim(text)
    number = trimmed.try_cast("double")
    parsed = _first_parse(F.upper(trimmed), formats)
    clock = F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed)
    return (
        F.when(
            (number >= 0) & (number < 1),
            (F.rint(number * SECONDS_PER_DAY).cast("int") % SECONDS_PER_DAY),
        )
        .when(trimmed.rlike("[0-9]"), clock)
        .cast("int")
    )


def build_timestamp(date_text: Column, time_text: Column | None) -> Column:
    """Date and time of day combined; midnight without a time; NULL without a date."""
    date = parse_date(date_text)
    if time_text is None:
        return date
    seconds = F.coalesce(parse_time_seconds(time_text), F.lit(0))
    midnight = F.date_trunc("day", date).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def request_timestamp(text: Column) -> tuple[Column, Column]:
    """(timestamp, error text) of a request time given as text; one of both is NULL."""
    trimmed = F.regexp_replace(F.trim(text), "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    parsed = F.coalesce(
        trimmed.try_cast("timestamp_ntz"), parse_date(trimmed)
    )
    error = F.when(
        parsed.isNull(),
        F.concat(
            F.lit("Invalid timestamp '"), F.coalesce(text, F.lit("NULL")),
            F.lit("'. Provide an ISO-like datetime string."),
        ),
    )
    return parsed, error


def calendar_parts(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "month": F.month(ts),
        "is_weekend": weekday.isin(5, 6).cast("int"),
        "day_of_year": F.dayofyear(ts),
    }


def cyclic_parts(hour: Column, day_of_year: Column) -> dict[str, Column]:
    turn = 2.0 * 3.141592653589793
    return {
        "hour_sin": F.sin(hour * turn / 24),
        "hour_cos": F.cos(hour * turn / 24),
        "day_sin": F.sin(day_of_year * turn / 366),
        "day_cos": F.cos(day_of_year * turn / 366),
    }


def holiday_coercion(value: Column | None) -> Column:
    """0/1 flag from whatever was imported; missing or non-numeric gives 0."""
    if value is None:
        return F.lit(0)
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (anonymous Gregorian computus)."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden = year % 19
    century, rest = div(year, 100), year % 100
    skipped = century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + skipped + 15) % 30
    correction = (
        F.lit(32) + (century % 4) * 2 + div(rest, 4) * 2 - epact - rest % 4
    ) % 7
    shift = div(golden + epact * 11 + correction * 22, 451)
    serial = epact + correction - shift * 7 + 114
    return F.make_date(year, div(serial, 31), serial % 31 + 1)


def _nth_monday(year: Column, month: int, n: int) -> Column:
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, "MON"), 7 * (n - 1))


def _last_monday_until(year: Column, month: int, day: int) -> Column:
    return F.date_sub(F.next_day(F.make_date(year, F.lit(month), F.lit(day)), "MON"), 7)


def holidays_of_year(year: Column, variant: str = "calendar") -> Column:
    """Array of the holiday dates of a year.

    ``calendar``: the Monday before 25 May, no August holiday (the rule in force).
    ``cleaning``: the May Monday may fall on the 25th. ``request``: adds the first Monday of August.
    """
    if variant not in ("calendar", "cleaning", "request"):
        raise ValueError(f"Unknown holiday variant: {variant}")
    year = year.cast("int")

    def fixed(month: int, day: int) -> Column:
        return F.make_date(year, F.lit(month), F.lit(day))

    dates = [
        fixed(1, 1),
        _nth_monday(year, 2, 3),
        F.date_sub(easter_sunday(year), 2),
        _last_monday_until(year, 5, 25 if variant == "cleaning" else 24),
        fixed(7, 1),
        _nth_monday(year, 9, 1),
        _nth_monday(year, 10, 2),
        fixed(12, 25),
        fixed(12, 26),
    ]
    if variant == "request":
        dates.append(_nth_monday(year, 8, 1))
    return F.array(*dates)


def is_holiday(ts: Column, variant: str = "calendar") -> Column:
    date = ts.cast("date")
    return F.coalesce(
        F.array_contains(holidays_of_year(F.year(date), variant), date).cast("int"), F.lit(0)
    )
