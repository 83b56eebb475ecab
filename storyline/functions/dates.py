"""Date functions as Column expressions; times are UTC, "local" is UTC-3 without daylight saving."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def age_label(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    count = lambda unit, name: F.concat(F.lit("há "), F.floor(s / unit).cast("string"), F.lit(f" {name}"))
    return F.when(s >= 86400, count(86400, "dias")).when(s >= 3600, count(3600, "horas")).when(s >= 60, count(60, "minutos")).otherwise("há poucos segundos")


def age_label_of_text(text: Column, now: Column) -> Column:
    ts = F.try_to_timestamp(text)
    return F.when(ts.isNull(), "timestamp inválido").otherwise(age_label(ts, now))


def local_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "-03:00")


def local_date(ts: Column) -> Column:
    return F.to_date(local_time(ts))


def parse_local_date(text: Column) -> Column:
    """ISO dates stand as they are; dates with a time and dd/mm/yyyy are UTC times and shift three hours back."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    timed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(text))
    slashed = F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))
    return F.coalesce(iso, local_date(F.coalesce(timed, slashed)))


def long_date(text: Column, end_of_day: bool = False) -> Column:
    """'3 de março de 2025 às 14:05' as a timestamp; null where it can't be read."""
    m = r"(?iU)^\s*(\d{1,2}) de (\p{L}+) de (\d{4})(?:\s+às\s+(\d{1,2}):(\d{2}))?\s*$"
    part = lambda i: F.regexp_extract(text, m, i)
    month = F.array_position(F.array(*(F.lit(x) for x in MONTHS)), F.lower(part(2)))
    clock = lambda i, default: F.coalesce(part(i).try_cast("int"), F.lit(default))
    stamp = F.format_string("%s-%02d-%02d %02d:%02d:%02d", part(3), month, part(1).try_cast("int"), clock(4, 23 if end_of_day else 0), clock(5, 59 if end_of_day else 0), F.lit(59 if end_of_day else 0))
    return F.when((month > 0) & part(1).try_cast("int").isNotNull(), F.try_to_timestamp(stamp))


def in_last_day(ts: Column, now: Column, dates_too: bool = False) -> Column:
    inside = (ts >= now - F.expr("INTERVAL 24 HOURS")) & (ts <= now)
    return inside | (F.to_date(ts) == F.to_date(now)) if dates_too else inside


def on_day(ts: Column, day: Column) -> Column:
    """The half-open day as a range, which reaches the scan."""
    return (ts >= day.cast("timestamp")) & (ts < F.date_add(day, 1).cast("timestamp"))
