"""Panel construction: reshape, enrich, densify, validate, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.joins import join_small
from demandloom.functions.windows import by_series, share

# The identity columns of a series and the panel's column order.
ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
PANEL_COLS = [
    *ID_COLS, "d", "date", "wm_yr_wk", "sales", "sell_price", "snap",
    "event_name_1", "event_type_1", "event_name_2", "event_type_2",
]
BLOCK = "d_block"
BLOCK_DAYS = 182
DAY_PREFIX = "d_"
FLAG_PREFIX = "snap_"


class PanelError(ValueError):
    """The panel breaks its contract; the message lists every broken rule."""


def melt_days(sales: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Wide sales (one column per day) to one row per (series, day).

    One generator over an array of the day columns: the row is read once, where
    ``unpivot`` would expand it through one projection per day. ``keep`` are
    further columns of the series to carry along.
    """
    day_cols = [c for c in sales.columns if c.startswith(DAY_PREFIX)]
    # as SQL text: thousands of Column objects would cost seconds to build
    days = F.expr("array(" + ", ".join(c[len(DAY_PREFIX):] for c in day_cols) + ")")
    values = F.expr("array(" + ", ".join(f"`{c}`" for c in day_cols) + ")")
    return sales.select(*ID_COLS, *keep, F.posexplode(values).alias("pos", "sales")).select(
        *ID_COLS, *keep, F.element_at(days, F.col("pos") + 1).cast("short").alias("d"), "sales"
    )


def own_state_flag(df: DataFrame, prefix: str = FLAG_PREFIX) -> DataFrame:
    """Collapse the per-state flag columns into the one of the row's own state, else 0."""
    flags = [c for c in df.columns if c.startswith(prefix)]
    own: Column = F.lit(0)
    for flag in flags:
        own = F.when(F.col("state_id") == flag[len(prefix):], F.col(f"`{flag}`")).otherwise(own)
    return df.withColumn("snap", own.cast("byte")).drop(*flags)


def join_calendar(long: DataFrame, calendar: DataFrame) -> DataFrame:
    """Left join of the day-level calendar, then the row's own state flag.

    The calendar is broadcast once a count shows it to be small.
    """
    days = calendar.withColumn("d", F.substring("d", len(DAY_PREFIX) + 1, 10).cast("short"))
    return own_state_flag(join_small(long, days, ["d"]))


def join_prices(long: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join of the weekly price; an item not offered that week keeps null."""
    return long.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")


def assemble(sales: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Wide sales, calendar and prices to the panel.

    The same rows as melt, calendar join and ``join_prices`` in turn, but prices
    meet sales while a series is still one row: its weekly prices travel as a map
    (one entry per week) that every day looks up. The long panel, by far the
    largest table, is not shuffled at all.
    """
    weekly = F.map_from_entries(F.collect_list(F.struct("wm_yr_wk", "sell_price")))
    by_series = prices.groupBy("store_id", "item_id").agg(weekly.alias("_prices"))
    wide = sales.join(by_series, ["store_id", "item_id"], "left")
    long = join_calendar(melt_days(wide, ["_prices"]), calendar)
    return long.withColumn("sell_price", F.element_at("_prices", F.col("wm_yr_wk"))).select(*PANEL_COLS)


def clustered(panel: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a series together and in day order, without a global sort."""
    spread = panel.repartition(partitions, "id") if partitions else panel.repartition("id")
    return spread.sortWithinPartitions("id", "d")


def densify(rows: DataFrame, first_day: int | Column, last_day: int | Column, fill: dict[str, object], keep: list[str]) -> DataFrame:
    """One row per (series, day) from sparse rows unique in (id, d).

    Each row also emits the empty days up to the next row of its series, so
    there is neither a series x day product nor a join, and the rows stay
    partitioned by ``id`` for the windows that follow. ``keep`` are columns that
    are constant in a series; every other column takes its ``fill`` value. A row
    without a day, or outside first_day..last_day, fails the job.
    """
    order = by_series()
    first, last = F.lit(first_day), F.lit(last_day)
    inside = F.coalesce(F.col("d").between(first, last), F.lit(False))
    message = F.format_string("day %s is outside %s to %s", F.col("d").cast("string"), first.cast("string"), last.cast("string"))
    begin = (
        F.when(~inside, F.raise_error(message).cast("int"))
        .when(F.lag("d").over(order).isNull(), first)
        .otherwise(F.col("d"))
    )
    end = F.coalesce(F.lead("d").over(order) - 1, last)
    spans = rows.withColumn("_days", F.sequence(begin.cast("int"), end.cast("int")))
    filled = [
        F.when(F.col("_day") == F.col("d"), F.col(name)).otherwise(F.lit(value)).alias(name)
        for name, value in fill.items()
    ]
    return spans.withColumn("_day", F.explode("_days")).select(*keep, F.col("_day").alias("d"), *filled)


def day_block(day: Column) -> Column:
    """The block of days a stored panel keeps together."""
    return F.floor((day - 1) / BLOCK_DAYS).cast("int")


def day_slice(panel: DataFrame, first: int | None = None, last: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows with first <= d <= last, projected; both reach a Parquet scan.

    On a panel stored in blocks of days the bounds also prune whole blocks.
    """
    stored = BLOCK in panel.columns
    kept = panel
    if first is not None:
        kept = kept.where(F.col("d") >= first)
        kept = kept.where(F.col(BLOCK) >= (first - 1) // BLOCK_DAYS) if stored else kept
    if last is not None:
        kept = kept.where(F.col("d") <= last)
        kept = kept.where(F.col(BLOCK) <= (last - 1) // BLOCK_DAYS) if stored else kept
    return kept.select(*columns) if columns else kept


def split_at(panel: DataFrame, train_end: int, horizon: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, actuals of the next ``horizon`` days, the rows to forecast)."""
    history = day_slice(panel, None, train_end, ["id", "d", "sales"])
    actuals = day_slice(panel, train_end + 1, train_end + horizon, ["id", "d", "sales"])
    return history, actuals, actuals.select("id", "d")


def series_dimension(panel: DataFrame, columns: list[str] = ID_COLS) -> DataFrame:
    """One row per series with its identity columns."""
    others = [c for c in columns if c != "id"]
    return panel.groupBy("id").agg(*[F.min(c).alias(c) for c in others])


def violation_counts(panel: DataFrame, n_series: int, n_days: int) -> DataFrame:
    """One row with the size of each broken rule; all zero on a valid panel.

    Row count and value rules are one partial aggregate. The distinct days are
    counted on one row per (day, date), not by a distinct count over the panel.
    """
    per_day = panel.groupBy("d", "date").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("sales").isNull()).alias("null_sales"),
        F.count_if(F.col("sales") < 0).alias("negative_sales"),
        F.count_if((F.col("sales") > 0) & F.col("sell_price").isNull()).alias("sold_without_price"),
    )
    return per_day.agg(
        F.abs(F.coalesce(F.sum("rows"), F.lit(0)) - n_series * n_days).alias("row_gap"),
        F.coalesce(F.sum("null_sales"), F.lit(0)).alias("null_sales"),
        F.coalesce(F.sum("negative_sales"), F.lit(0)).alias("negative_sales"),
        F.abs(F.countDistinct("d") - n_days).alias("day_gap"),
        F.abs(F.countDistinct("date") - n_days).alias("date_gap"),
        F.coalesce(F.sum("sold_without_price"), F.lit(0)).alias("sold_without_price"),
    )


# What each violation column means to a reader of the error.
_RULES = {
    "row_gap": "row count is off series x days by {}",
    "null_sales": "{} rows with null sales",
    "negative_sales": "{} rows with negative sales",
    "day_gap": "distinct days differ from the expected number by {}",
    "date_gap": "distinct dates differ from the expected number by {}",
    "sold_without_price": "{} rows sold units without a price",
}


def _refuse(found: dict) -> None:
    broken = [text.format(found[rule]) for rule, text in _RULES.items() if found[rule]]
    if broken:
        raise PanelError("panel is not valid: " + "; ".join(broken))


def validate(panel: DataFrame, n_series: int, n_days: int) -> DataFrame:
    """Raise PanelError naming every broken rule; else the summary row."""
    _refuse(violation_counts(panel, n_series, n_days).first().asDict())
    return summary(panel)


# Distinct days are counted by a bitmap of fixed size, so that they can be observed while rows pass by.
BITMAP_DAYS = 32_768


def _day_bits(number: Column) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(number, F.lit(BITMAP_DAYS)) + 1))


def observed_rules() -> list[Column]:
    """What ``check_observed`` needs to know, as metrics for ``DataFrame.observe``."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("sales").isNull()).alias("null_sales"),
        F.count_if(F.col("sales") < 0).alias("negative_sales"),
        F.count_if((F.col("sales") > 0) & F.col("sell_price").isNull()).alias("sold_without_price"),
        F.count_if(F.col("sales") == 0).alias("zeros"),
        F.count_if(F.col("sell_price").isNull()).alias("no_price"),
        _day_bits(F.col("d").cast("long")).alias("days"),
        _day_bits(F.unix_date("date").cast("long")).alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ]


def check_observed(found: dict, n_series: int, n_days: int) -> dict:
    """Raise PanelError as ``validate`` does; else the values of ``summary``, unrounded and with the series as stated."""
    if n_days > BITMAP_DAYS:
        raise ValueError(f"over {BITMAP_DAYS} days: use validate")
    days, dates = (sum(byte.bit_count() for byte in bytes(found[name])) for name in ("days", "dates"))
    gaps = {"row_gap": abs(found["rows"] - n_series * n_days), "day_gap": abs(days - n_days), "date_gap": abs(dates - n_days)}
    _refuse({**found, **gaps})
    first, last, rows = found["first_date"], found["last_date"], found["rows"]
    return {
        "rows": rows,
        "series": n_series,
        "days": (last - first).days + 1,
        "date_range": f"{first} to {last}",
        "zero_sales_frac": found["zeros"] / rows,
        "price_missing_frac": found["no_price"] / rows,
    }


def summary(panel: DataFrame) -> DataFrame:
    """Rows, series, days, date range, zero and missing-price fractions, in one row."""
    per_series = panel.groupBy("id").agg(
        F.count("*").alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(F.col("sales") == 0).alias("zeros"),
        F.count_if(F.col("sell_price").isNull()).alias("no_price"),
    )
    return per_series.agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("series"),
        (F.datediff(F.max("last_date"), F.min("first_date")) + 1).alias("days"),
        F.concat_ws(" to ", F.min("first_date").cast("string"), F.max("last_date").cast("string")).alias("date_range"),
        F.round(share(F.sum("zeros"), F.sum("rows")), 4).alias("zero_sales_frac"),
        F.round(share(F.sum("no_price"), F.sum("rows")), 4).alias("price_missing_frac"),
    )
