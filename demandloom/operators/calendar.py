"""Calendar features: date parts and distances to events. All known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions.joins import join_small

# Fixed values.
EVENT_CAP = 30
BASE_YEAR = 2011


def date_parts(df: DataFrame, base_year: int = BASE_YEAR) -> DataFrame:
    """Weekday (Monday = 0), weekend, day of month, ISO week, month, year, Christmas."""
    day = F.col("date")
    return df.withColumns(
        {
            "dow": F.weekday(day),
            "is_weekend": (F.weekday(day) >= 5).cast("int"),
            "dom": F.dayofmonth(day),
            "week": F.weekofyear(day),
            "month": F.month(day),
            "year": F.year(day) - base_year,
            "is_christmas": ((F.month(day) == 12) & (F.dayofmonth(day) == 25)).cast("int"),
        }
    )


def event_days(calendar: DataFrame) -> DataFrame:
    """The distinct days with a named event; takes a calendar or a panel."""
    return calendar.where(F.col("event_name_1").isNotNull()).select("d").distinct()


def event_distances(events: DataFrame, cap: int = EVENT_CAP) -> DataFrame:
    """Days nearer than ``cap`` to an event, with the distance to the next and from the last.

    Each event reaches out to its neighbour days, so no day needs to see the
    whole calendar.
    """
    near = events.select(F.col("d").alias("_event"), F.explode(F.sequence(F.lit(1 - cap), F.lit(cap - 1))).alias("_off"))
    return near.groupBy((F.col("_event") + F.col("_off")).cast("int").alias("d")).agg(
        F.min(F.when(F.col("_off") <= 0, -F.col("_off"))).alias("days_to_event"),
        F.min(F.when(F.col("_off") >= 0, F.col("_off"))).alias("days_since_event"),
    )


def event_features(df: DataFrame, events: DataFrame | None = None, cap: int = EVENT_CAP) -> DataFrame:
    """``days_to_event``, ``days_since_event`` (both capped) and ``is_event``.

    ``events`` holds the event days of the full calendar. Without it only events
    on days present in ``df`` count, so the last days cannot see the next one.
    """
    distances = event_distances(event_days(df) if events is None else events, cap)
    joined = join_small(df, distances, ["d"])
    return joined.withColumns(
        {
            "days_to_event": F.coalesce("days_to_event", F.lit(cap)),
            "days_since_event": F.coalesce("days_since_event", F.lit(cap)),
            "is_event": F.coalesce((F.col("days_to_event") == 0).cast("int"), F.lit(0)),
        }
    )


def calendar_features(df: DataFrame, events: DataFrame | None = None, base_year: int = BASE_YEAR) -> DataFrame:
    return event_features(date_parts(df, base_year), events)
