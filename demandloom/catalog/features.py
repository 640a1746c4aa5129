"""Feature queries: target, calendar, price, and the full table."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import PANEL_SELECT, TRAIN_END, Entry, big, entry, r, rr, with_panel
from demandloom.operators import calendar as CL
from demandloom.operators import features as FT
from demandloom.operators import price as PR
from demandloom.plans import retail
from demandloom.plans.features import FEATURE_COLS, build_features

SHIFT = FT.HORIZON


def _sales(spark, sf):
    return retail.panel(spark, sf).select("id", "d", "sales")


def _events(spark, sf):
    return CL.event_days(retail.event_calendar(spark, sf))


def features(spark, sf):
    return build_features(retail.panel(spark, sf), _events(spark, sf))


def _prices(spark, sf):
    return retail.panel(spark, sf).select("id", "d", "wm_yr_wk", "sell_price")


def _rolling(stat):
    def build(spark, sf):
        made = FT.rolling_features(_sales(spark, sf), stats=(stat,))
        return made.drop("sales")

    return build


_AGGREGATES = {
    "mean": "avg(sales)",
    "std": "stddev_samp(sales)",
    "median": "median(sales)",
    "zero_frac": "avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END)",
}


def _frame(days: int) -> str:
    return f"(PARTITION BY id ORDER BY d RANGE BETWEEN {SHIFT + days - 1} PRECEDING AND {SHIFT} PRECEDING)"


def _rolled(stat: str, days: int) -> str:
    least = max(days // 2, 2)
    return f"CASE WHEN count(sales) OVER {_frame(days)} >= {least} THEN {_AGGREGATES[stat]} OVER {_frame(days)} END"


_PAST = f"(PARTITION BY id ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND {SHIFT} PRECEDING)"
_K = 1 - FT.EWM_ALPHAS[0]
_EWM = f"sum(sales * pow({_K}, -d)) OVER {_PAST} / sum(pow({_K}, -d)) OVER {_PAST}"

_TARGET_CTE = f"""
target AS (
  SELECT id, d,
  {", ".join(f"CAST(lag(sales, {lag}) OVER (PARTITION BY id ORDER BY d) AS DOUBLE) AS sales_lag_{lag}" for lag in FT.LAGS)},
  {", ".join(f"{_rolled(stat, w)} AS r_{stat}_{w}" for w in FT.WINDOWS for stat in FT.STATS)},
  {_EWM} AS ewm_a1,
  avg(sales) OVER {_PAST} AS hist_mean
  FROM panel
)"""

EVENT_CTE = f"""
event AS (SELECT d AS e FROM days WHERE event_name_1 IS NOT NULL),
dist AS (
  SELECT d, least({CL.EVENT_CAP}, coalesce((SELECT min(e) FROM event WHERE e >= d) - d, {CL.EVENT_CAP})) AS days_to_event,
         least({CL.EVENT_CAP}, coalesce(d - (SELECT max(e) FROM event WHERE e <= d), {CL.EVENT_CAP})) AS days_since_event
  FROM days
)"""

WEEKLY_CTE = f"""
weekly AS (
  SELECT id, wm_yr_wk, arg_min(sell_price, d) AS sell_price FROM panel WHERE sell_price IS NOT NULL GROUP BY id, wm_yr_wk
),
trail AS (
  SELECT id, wm_yr_wk,
         CASE WHEN count(*) OVER w >= {PR.MEDIAN_MIN_WEEKS} THEN median(sell_price) OVER w END AS trail_med
  FROM weekly WINDOW w AS (PARTITION BY id ORDER BY wm_yr_wk ROWS BETWEEN {PR.MEDIAN_WEEKS - 1} PRECEDING AND CURRENT ROW)
),
priced AS (
  SELECT p.id, p.d, p.sell_price, trail_med, p.sell_price / nullif(trail_med, 0) AS price_rel_med,
         CAST(coalesce(p.sell_price / nullif(trail_med, 0) < {PR.PROMO_THRESHOLD}, FALSE) AS BIGINT) AS is_promo,
         p.sell_price / nullif(lag(p.sell_price, 7) OVER (PARTITION BY p.id ORDER BY p.d), 0) - 1 AS price_chg_7,
         p.sell_price / nullif(avg(p.sell_price) OVER (PARTITION BY store_id, dept_id, p.d), 0) AS price_rel_dept
  FROM panel p LEFT JOIN trail USING (id, wm_yr_wk)
)"""

DATE_PARTS = {
    "dow": "isodow(date) - 1",
    "is_weekend": "isodow(date) >= 6",
    "dom": "day(date)",
    "week": "week(date)",
    "month": "month(date)",
    "year": f"year(date) - {CL.BASE_YEAR}",
    "is_christmas": "month(date) = 12 AND day(date) = 25",
}
_DATE_SELECT = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in DATE_PARTS.items())
_EVENT_SELECT = big("days_to_event", "days_since_event") + ", CAST(days_to_event = 0 AS BIGINT) AS is_event"

_EVENT_SQL = with_panel(f"SELECT id, {big('d')}, event_name_1, {_EVENT_SELECT} FROM panel JOIN dist USING (d)", EVENT_CTE)


def _momentum(spark, sf):
    made = FT.rolling_features(_sales(spark, sf), windows=(7, 28), stats=("mean",))
    return FT.momentum(made).select("id", "d", "momentum_7_28")


def _leaks(spark, sf):
    day = TRAIN_END
    columns = [c for c in FT.target_features(_sales(spark, sf)).columns if c not in ("id", "d", "sales")]
    leaked = FT.leaked_rows(_sales(spark, sf), FT.target_features, day, columns)
    return leaked.agg(F.count("*").alias("leaked_rows"))


_FLOATS = [c for c in FEATURE_COLS if c.startswith(("r_", "ewm", "hist", "momentum", "price_"))]
_MOMENTUM = "CASE WHEN r_mean_28 > 0 THEN r_mean_7 / r_mean_28 END"
_JOINED_CTE = f"""
joined AS (
  SELECT panel.*, target.* EXCLUDE (id, d), {_MOMENTUM} AS momentum_7_28,
         days_to_event, days_since_event, price_chg_7, price_rel_med, is_promo, price_rel_dept
  FROM panel JOIN target USING (id, d) JOIN dist USING (d) JOIN priced USING (id, d)
)"""
FEATURE_CTES = (_TARGET_CTE, EVENT_CTE, WEEKLY_CTE, _JOINED_CTE)

ENTRIES: dict[str, Entry] = {
    "ft_lags": entry(
        lambda s, sf: FT.lag_features(_sales(s, sf)).drop("sales"),
        with_panel(
            f"SELECT id, {big('d')}, " + ", ".join(f"sales_lag_{lag}" for lag in FT.LAGS) + " FROM target", _TARGET_CTE
        ),
    ),
    **{
        f"ft_rolling_{stat}": entry(
            _rolling(stat),
            with_panel(
                f"SELECT id, {big('d')}, "
                + ", ".join(r(_rolled(stat, w), f"r_{stat}_{w}") for w in FT.WINDOWS) + " FROM panel"
            ),
        )
        for stat in FT.STATS
    },
    "ft_ewm": entry(
        lambda s, sf: FT.ewm_features(_sales(s, sf)).drop("sales"),
        with_panel(f"SELECT id, {big('d')}, {r(_EWM, 'ewm_a1')} FROM panel"),
    ),
    "ft_historical_mean": entry(
        lambda s, sf: FT.historical_mean(_sales(s, sf)).drop("sales"),
        with_panel(f"SELECT id, {big('d')}, {r(f'avg(sales) OVER {_PAST}', 'hist_mean')} FROM panel"),
    ),
    "ft_momentum": entry(
        _momentum,
        with_panel(
            f"SELECT id, {big('d')}, {r(_MOMENTUM, 'momentum_7_28')} FROM roll",
            f"roll AS (SELECT id, d, {_rolled('mean', 7)} AS r_mean_7, {_rolled('mean', 28)} AS r_mean_28 FROM panel)",
        ),
    ),
    "ft_leakage": entry(_leaks, with_panel("SELECT CAST(0 AS BIGINT) AS leaked_rows FROM (SELECT count(*) FROM panel)")),
    "cl_date_parts": entry(
        lambda s, sf: CL.date_parts(retail.panel(s, sf).select("id", "d", "date")),
        with_panel(f"SELECT id, {big('d')}, CAST(date AS VARCHAR) AS date, {_DATE_SELECT} FROM panel"),
    ),
    "cl_event_distances": entry(
        lambda s, sf: CL.event_features(retail.panel(s, sf).select("id", "d", "event_name_1"), _events(s, sf)), _EVENT_SQL
    ),
    "cl_event_distances_panel_days": entry(
        lambda s, sf: CL.event_features(retail.panel(s, sf).select("id", "d", "event_name_1")), _EVENT_SQL
    ),
    "pr_week_change": entry(
        lambda s, sf: PR.week_change(retail.panel(s, sf).select("id", "d", "sell_price")),
        with_panel(f"SELECT id, {big('d')}, {rr('sell_price', 'price_chg_7')} FROM priced", WEEKLY_CTE),
    ),
    "pr_weekly_prices": entry(
        lambda s, sf: PR.weekly_prices(retail.panel(s, sf)),
        with_panel(f"SELECT id, {big('wm_yr_wk')}, {rr('sell_price')} FROM weekly", WEEKLY_CTE),
    ),
    "pr_weekly_trailing_median": entry(
        lambda s, sf: PR.weekly_trailing_median(PR.weekly_prices(retail.panel(s, sf))).drop("sell_price"),
        with_panel(f"SELECT id, {big('wm_yr_wk')}, {rr('trail_med')} FROM trail", WEEKLY_CTE),
    ),
    "pr_trailing_median": entry(
        lambda s, sf: PR.trailing_median(_prices(s, sf)).drop("wm_yr_wk"),
        with_panel(f"SELECT id, {big('d')}, {rr('sell_price', 'trail_med')} FROM priced", WEEKLY_CTE),
    ),
    "pr_promotion": entry(
        lambda s, sf: PR.promotion(_prices(s, sf)).drop("wm_yr_wk"),
        with_panel(f"SELECT id, {big('d')}, is_promo, {rr('sell_price', 'price_rel_med')} FROM priced", WEEKLY_CTE),
    ),
    "pr_shelf_price": entry(
        lambda s, sf: PR.shelf_price(
            retail.panel(s, sf).select("id", "store_id", "dept_id", "d", "sell_price")
        ).drop("store_id", "dept_id"),
        with_panel(f"SELECT id, {big('d')}, {rr('sell_price', 'price_rel_dept')} FROM priced", WEEKLY_CTE),
    ),
    "pr_feature_table": entry(
        features,
        with_panel(
            f"SELECT {PANEL_SELECT}, {', '.join(f'sales_lag_{lag}' for lag in FT.LAGS)}, is_promo, "
            f"{_DATE_SELECT}, {_EVENT_SELECT}, {rr(*_FLOATS)} FROM joined",
            *FEATURE_CTES,
        ),
    ),
}
