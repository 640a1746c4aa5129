"""Shared parts of the catalog: output types, cutoffs, and the SQL of the panel."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.operators.metrics import expanding_folds
from demandloom.plans import retail

Run = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Run
    sql: str | None


# Cutoffs on the derived panel; days after LAST_DAY are in the panel, but no fold tests them.
HORIZON = retail.HORIZON
LAST_DAY = retail.LAST_FOLD_DAY
TRAIN_END = LAST_DAY - HORIZON
FOLDS = expanding_folds(3, HORIZON, LAST_DAY)
EVENT_FOLDS = expanding_folds(12, HORIZON, LAST_DAY)
MODELS = ("naive", "seasonal_naive_7", "moving_avg_28", "exp_smoothing")

_DECIMALS = 1_000_000


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: 6-digit doubles, longs, dates as text.

    Sums of doubles depend on their order, hence the rounding. It uses the same
    arithmetic as ``r`` below, so both engines round ties alike.
    """
    out = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = F.floor(value.cast("double") * _DECIMALS + 0.5) / float(_DECIMALS)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            value = value.cast("long")
        elif isinstance(field.dataType, T.BooleanType):
            value = value.cast("int").cast("long")
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        out.append(value.alias(field.name))
    return df.select(*out)


def entry(build: Run, sql: str | None) -> Entry:
    return Entry(lambda spark, sf_dir: tidy(build(spark, sf_dir)), sql)


def r(expression: str, alias: str | None = None) -> str:
    """The rounding of ``tidy`` in SQL."""
    text = f"floor(CAST({expression} AS DOUBLE) * {_DECIMALS} + 0.5) / {_DECIMALS}.0"
    return f"{text} AS {alias}" if alias else text


def rr(*columns: str) -> str:
    return ", ".join(r(c, c) for c in columns)


def big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


def _case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


_EVENT_RULES = [(f"month(date) = {m} AND day(date) = {d}", name, kind) for m, d, name, kind in retail.EVENTS]
_FLAG_RULES = [
    (f"i.state_id = '{state}'", f"CAST(day(date) BETWEEN {first} AND {first + retail.FLAG_DAYS - 1} AS INTEGER)")
    for state, first in retail.FIRST_FLAG_DAY.items()
]

RAW = f"""
span AS (
  SELECT least(min(n), 1) AS first, greatest(max(n), {retail.LAST_FOLD_DAY}) AS last
  FROM (SELECT CAST(date_diff('day', DATE '{retail.FIRST_DATE}', CAST(l_shipdate AS DATE)) AS INTEGER) + 1 AS n FROM lineitem)
),
raw AS (
  SELECT p_type AS cat_id,
         p_type || '_' || CASE WHEN p_size <= 25 THEN '1' ELSE '2' END AS dept_id,
         lpad(CAST(p_size % 3 AS VARCHAR), 3, '0') AS kind,
         r_name AS state_id,
         r_name || '_' || CAST(l_suppkey % 2 + 1 AS VARCHAR) AS store_id,
         CAST(date_diff('day', DATE '{retail.FIRST_DATE}', CAST(l_shipdate AS DATE)) AS INTEGER) + 1 AS d,
         l_quantity AS quantity,
         CAST(l_extendedprice / l_quantity AS DECIMAL(18, 7)) AS unit_price
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE l_shipdate IS NOT NULL
),
daily AS (
  SELECT dept_id || '_' || kind || '_' || store_id AS id, dept_id || '_' || kind AS item_id,
         dept_id, cat_id, store_id, state_id, d,
         CAST(sum(quantity) AS BIGINT) AS sales, sum(unit_price) AS price_sum, count(*) AS price_n
  FROM raw GROUP BY ALL
),
ids AS (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM daily),
days AS (
  SELECT d, date, CAST(floor((d - 1) / 7) AS INTEGER) AS wm_yr_wk,
         {_case([(c, f"'{n}'") for c, n, _ in _EVENT_RULES], "NULL")} AS event_name_1,
         {_case([(c, f"'{k}'") for c, _, k in _EVENT_RULES], "NULL")} AS event_type_1
  FROM (SELECT d, CAST(DATE '{retail.FIRST_DATE}' + CAST(d - 1 AS INTEGER) AS DATE) AS date
        FROM (SELECT CAST(unnest(range(first, last + 1)) AS INTEGER) AS d FROM span))
),
price AS (
  SELECT store_id, item_id, CAST(floor((d - 1) / 7) AS INTEGER) AS wm_yr_wk,
         CAST(sum(price_sum) AS DOUBLE) / sum(price_n) AS sell_price
  FROM daily GROUP BY ALL
)"""

PANEL = RAW + f""",
panel AS MATERIALIZED (
  SELECT i.id, i.item_id, i.dept_id, i.cat_id, i.store_id, i.state_id, t.d, t.date, t.wm_yr_wk,
         coalesce(s.sales, 0) AS sales, p.sell_price,
         {_case(_FLAG_RULES, "0")} AS snap,
         t.event_name_1, t.event_type_1, CAST(NULL AS VARCHAR) AS event_name_2, CAST(NULL AS VARCHAR) AS event_type_2
  FROM ids i CROSS JOIN days t
  LEFT JOIN daily s ON s.id = i.id AND s.d = t.d
  LEFT JOIN price p ON p.store_id = i.store_id AND p.item_id = i.item_id AND p.wm_yr_wk = t.wm_yr_wk
)"""

PANEL_SELECT = (
    "id, item_id, dept_id, cat_id, store_id, state_id, "
    + big("d") + ", CAST(date AS VARCHAR) AS date, " + big("wm_yr_wk", "sales") + ", "
    + r("sell_price", "sell_price") + ", " + big("snap")
    + ", event_name_1, event_type_1, event_name_2, event_type_2"
)


def fold_values(folds) -> str:
    return ", ".join(f"({f.fold_id}, {f.train_end})" for f in folds)


def baseline_ctes(folds) -> str:
    """``fold`` and ``fc`` (model, fold, id, d, yhat) with the four baselines."""
    return f"""
fold AS (SELECT * FROM (VALUES {fold_values(folds)}) AS t(fold, cut)),
step AS (SELECT CAST(range AS INTEGER) AS h FROM range(1, {HORIZON + 1})),
lvl AS (
  SELECT fold, cut, id,
         CAST(max(CASE WHEN d = cut THEN sales END) AS DOUBLE) AS naive,
         avg(CASE WHEN d > cut - 28 THEN sales END) AS mean28,
         sum(sales * pow(0.8, cut - d)) / sum(pow(0.8, cut - d)) AS smooth
  FROM panel JOIN fold ON d <= cut GROUP BY fold, cut, id
),
fc AS MATERIALIZED (
  SELECT 'naive' AS model, fold, id, cut + h AS d, naive AS yhat FROM lvl CROSS JOIN step
  UNION ALL SELECT 'moving_avg_28', fold, id, cut + h, mean28 FROM lvl CROSS JOIN step
  UNION ALL SELECT 'exp_smoothing', fold, id, cut + h, smooth FROM lvl CROSS JOIN step
  UNION ALL
  SELECT 'seasonal_naive_7', fold, id, cut + h, CAST(sales AS DOUBLE)
  FROM fold CROSS JOIN step JOIN panel ON d = cut + h - 7 * CAST(ceil(h / 7.0) AS INTEGER)
)"""


LAST_FOLD = f"(SELECT model, id, d, yhat FROM fc WHERE fold = {FOLDS[-1].fold_id})"
TEST_ROWS = f"(SELECT * FROM panel WHERE d > {TRAIN_END} AND d <= {TRAIN_END + HORIZON})"


def with_panel(select: str, *ctes: str) -> str:
    """SQL text with the panel, further common tables, and the final select."""
    return "WITH " + ",".join([PANEL, *ctes]) + "\n" + select


def with_forecasts(select: str, *ctes: str) -> str:
    return with_panel(select, baseline_ctes(FOLDS), *ctes)
