"""The panel of daily unit sales held in the order tables (lineitem, part, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.operators import panel as P

# Fixed values of the derived panel: the date that day numbers count from, and the day the folds end at.
# The panel's own span comes from the data (``span``).
FIRST_DATE = "1995-01-02"
LAST_FOLD_DAY = 2499
HORIZON = 28
FIRST_FLAG_DAY = {"AFRICA": 1, "AMERICA": 3, "ASIA": 5, "EUROPE": 7, "MIDDLE EAST": 9}
FLAG_DAYS = 10
EVENTS = [
    (1, 1, "NewYear", "National"),
    (7, 4, "IndependenceDay", "National"),
    (12, 25, "Christmas", "Religious"),
]
PRICE_TYPE = "decimal(18,7)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_number(date):
    return F.datediff(date, F.lit(FIRST_DATE)) + 1


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (first, last): the days of all line items, and at least day 1 and the last day of the folds."""
    shipped = table(spark, sf_dir, "lineitem").select(_day_number(F.col("l_shipdate")).alias("d"))
    return shipped.agg(
        F.least(F.min("d"), F.lit(1)).alias("first"), F.greatest(F.max("d"), F.lit(LAST_FOLD_DAY)).alias("last")
    )


_known_days: dict[tuple, tuple[int, int]] = {}


def first_and_last_day(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """``span`` as two numbers, found once per session and set of files."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(table(spark, sf_dir, "lineitem").inputFiles())))
    if key not in _known_days:
        _known_days[key] = tuple(span(spark, sf_dir).first())
    return _known_days[key]


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and unit prices per (series, day) with at least one line item.

    Only five columns of lineitem are read. The group keys stay short codes; the
    id strings are built after the aggregation, on one row per series and day.
    Partial aggregation folds a hot series before it is shuffled. A line item
    that was not shipped yet has no day and is left out.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    regions = table(spark, sf_dir, "region").join(
        table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    stores = (
        table(spark, sf_dir, "supplier")
        .join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "r_name")
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        .where(F.col("l_shipdate").isNotNull())
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(stores, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    codes = {
        "_half": F.when(F.col("p_size") <= 25, 1).otherwise(2),
        "_kind": F.col("p_size") % 3,
        "_door": F.col("l_suppkey") % 2 + 1,
        "d": _day_number(F.col("l_shipdate")),
    }
    units = lines.withColumns(codes).groupBy("p_type", "_half", "_kind", "r_name", "_door", "d").agg(
        F.sum("l_quantity").cast("long").alias("sales"),
        F.sum((F.col("l_extendedprice") / F.col("l_quantity")).cast(PRICE_TYPE)).alias("price_sum"),
        F.count("*").alias("price_n"),
    )
    dept = F.concat_ws("_", "p_type", "_half")
    item = F.concat_ws("_", dept, F.lpad(F.col("_kind").cast("string"), 3, "0"))
    store = F.concat_ws("_", "r_name", "_door")
    return units.select(
        F.concat_ws("_", item, store).alias("id"),
        item.alias("item_id"),
        dept.alias("dept_id"),
        F.col("p_type").alias("cat_id"),
        store.alias("store_id"),
        F.col("r_name").alias("state_id"),
        "d", "sales", "price_sum", "price_n",
    )


def week_of(d):
    return F.floor((d - 1) / 7).cast("int")


def _mean_price(price_sum, price_n):
    return price_sum.cast("double") / F.nullif(price_n, F.lit(0))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly price table: mean unit price per (store, item, week)."""
    weekly = daily_sales(spark, sf_dir).groupBy("store_id", "item_id", week_of(F.col("d")).alias("wm_yr_wk"))
    return weekly.agg(_mean_price(F.sum("price_sum"), F.sum("price_n")).alias("sell_price"))


def _date(d):
    return F.date_add(F.lit(FIRST_DATE).cast("date"), d.cast("int") - 1)


def _event(date, position: int):
    value = F.lit(None).cast("string")
    for event in EVENTS:
        hit = (F.month(date) == event[0]) & (F.dayofmonth(date) == event[1])
        value = F.when(hit, F.lit(event[position])).otherwise(value)
    return value


def _flag(date, first_day: int):
    return F.dayofmonth(date).between(first_day, first_day + FLAG_DAYS - 1).cast("byte")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day of the panel: date, week, events and one flag per state."""
    date = F.col("date")
    first, last = first_and_last_day(spark, sf_dir)
    days = spark.range(first, last + 1).select(F.col("id").cast("int").alias("n")).withColumn("date", _date(F.col("n")))
    return days.select(
        F.concat(F.lit(P.DAY_PREFIX), F.col("n").cast("string")).alias("d"),
        "date",
        week_of(F.col("n")).alias("wm_yr_wk"),
        _event(date, 2).alias("event_name_1"),
        _event(date, 3).alias("event_type_1"),
        F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"),
        *[_flag(date, day).alias(P.FLAG_PREFIX + state) for state, day in FIRST_FLAG_DAY.items()],
    )


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, event_name_1) of the full calendar, with the integer day."""
    return calendar(spark, sf_dir).select(F.substring("d", len(P.DAY_PREFIX) + 1, 10).cast("int").alias("d"), "event_name_1")


def dense_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identity, d, sales, price parts), one row per series and day."""
    first, last = first_and_last_day(spark, sf_dir)
    fill = {"sales": 0, "price_sum": None, "price_n": None}
    return P.densify(daily_sales(spark, sf_dir), first, last, fill, P.ID_COLS)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole panel.

    One shuffle on ``id`` carries densification and the weekly price. Columns a
    query does not use are pruned, the price window with them.
    """
    week = Window.partitionBy("id", "wm_yr_wk")
    rows = dense_sales(spark, sf_dir).withColumns({"date": _date(F.col("d")), "wm_yr_wk": week_of(F.col("d"))})
    rows = rows.withColumns({"_sum": F.sum("price_sum").over(week), "_n": F.sum("price_n").over(week)})
    date = F.col("date")
    snap = F.lit(0).cast("byte")
    for state, first_day in FIRST_FLAG_DAY.items():
        snap = F.when(F.col("state_id") == state, _flag(date, first_day)).otherwise(snap)
    return rows.select(
        *P.ID_COLS, "d", "date", "wm_yr_wk", "sales",
        _mean_price(F.col("_sum"), F.col("_n")).alias("sell_price"),
        snap.alias("snap"),
        _event(date, 2).alias("event_name_1"),
        _event(date, 3).alias("event_type_1"),
        F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"),
    )


def wide_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series, one column per day: the layout of the raw sales file."""
    by_day = F.array_sort(F.collect_list(F.struct("d", "sales")))
    series = dense_sales(spark, sf_dir).groupBy(*P.ID_COLS).agg(by_day.alias("_days"))
    first, last = first_and_last_day(spark, sf_dir)
    days = [f"_days[{n - first}].sales AS `{P.DAY_PREFIX}{n}`" for n in range(first, last + 1)]
    return series.selectExpr(*P.ID_COLS, *days)
