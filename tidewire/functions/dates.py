"""Dates of many formats, editions and due dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(raw: Column) -> Column:
    """A UTC timestamp from ISO (no offset means UTC), compact, plain or mail dates; null where none fits."""
    x = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    mail = F.regexp_replace(x, r"^[A-Za-z]{3,9}, *", "")
    # The first try is for whole ISO values only: looser input must reach its own pattern.
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(x))
    return F.coalesce(
        iso,
        F.when(x.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmss'Z'"))),
        F.when(x.rlike(r"^\d{14}$"), F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{1,4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z"))),
    )


def edition_date(ts: Column, zone: Column) -> Column:
    """The calendar date of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def due_date(created: Column, horizon: Column) -> Column:
    """Ninety days on for a middle horizon, else thirty; null for an unusable date."""
    day = F.try_to_date(created)
    return F.date_add(day, F.when(horizon.contains("中期"), 90).otherwise(30))
