"""CSV scans with explicit types: wide sales, calendar, weekly prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.panel import DAY_PREFIX, FLAG_PREFIX, ID_COLS

# The columns of the raw files. Calendar flags follow the prefix.
CALENDAR_COLS = ["d", "date", "wm_yr_wk", "event_name_1", "event_type_1", "event_name_2", "event_type_2"]
PRICE_COLS = {
    "store_id": T.StringType(),
    "item_id": T.StringType(),
    "wm_yr_wk": T.IntegerType(),
    "sell_price": T.FloatType(),
}


def _header(spark: SparkSession, path: str) -> list[str]:
    """The column names; Spark reads the first line only."""
    return spark.read.option("header", True).csv(path).columns


def _scan(spark: SparkSession, path: str, types: dict[str, T.DataType]) -> DataFrame:
    """Read by a schema in file order; columns without a given type are strings."""
    fields = [T.StructField(c, types.get(c, T.StringType())) for c in _header(spark, path)]
    return spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "FAILFAST").csv(path)


def _require(df: DataFrame, columns: list[str], path: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """One row per series: identity columns, then one short per day found in the header."""
    days = {c: T.ShortType() for c in _header(spark, path) if c.startswith(DAY_PREFIX)}
    sales = _scan(spark, path, days)
    _require(sales, ID_COLS, path)
    return sales.select(*ID_COLS, *[f"`{c}`" for c in days])


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """One row per day: date, week, events and the state flags; other columns are dropped."""
    header = _header(spark, path)
    flags = [c for c in header if c.startswith(FLAG_PREFIX)]
    types: dict[str, T.DataType] = {"wm_yr_wk": T.IntegerType(), **{c: T.ByteType() for c in flags}}
    calendar = _scan(spark, path, types)
    _require(calendar, CALENDAR_COLS, path)
    return calendar.withColumn("date", F.to_date("date")).select(*CALENDAR_COLS, *[f"`{c}`" for c in flags])


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """One row per (store, item, week) on offer; a missing row means not offered."""
    prices = _scan(spark, path, PRICE_COLS)
    _require(prices, list(PRICE_COLS), path)
    return prices.select(*PRICE_COLS)
