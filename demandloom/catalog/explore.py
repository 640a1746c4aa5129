"""Exploratory queries."""

from __future__ import annotations

from demandloom.catalog.base import Entry, big, entry, r, rr, with_panel
from demandloom.operators import explore as X
from demandloom.operators.price import PROMO_THRESHOLD
from demandloom.plans import retail
from demandloom.plans.stages import panel_table

EVENT_NAMES = tuple(name for _, _, name, _ in retail.EVENTS)
# Fixed values of the derived panel, for the columns of the SQL text only.
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _daily(spark, sf):
    return X.daily_totals(retail.panel(spark, sf))


def _store_category(spark, sf):
    wide = X.store_category_means(retail.panel(spark, sf))
    return wide.withColumnsRenamed({c: c.lower() for c in wide.columns})


def _exemplar_view(spark, sf):
    panel = panel_table(spark, sf)
    return X.series_view(panel, X.promo_exemplar(panel))


_DAILY_CTE = """
tot AS (
  SELECT date, CAST(sum(sales) AS BIGINT) AS sales, isodow(date) - 1 AS dow, month(date) AS month FROM panel GROUP BY date
)"""
_ZERO_CTE = """
zero AS (SELECT id, avg(CASE WHEN sales = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_frac FROM panel GROUP BY id)"""
_CENTRED = "OVER (ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)"
_CANDIDATE_CTE = f"""
med AS (SELECT id, median(sell_price) AS median_price FROM panel WHERE sell_price IS NOT NULL GROUP BY id),
cand AS (
  SELECT id, avg(sales) FILTER (sell_price >= {PROMO_THRESHOLD} * median_price) AS base,
         avg(sales) FILTER (sell_price < {PROMO_THRESHOLD} * median_price) AS promo,
         count(*) FILTER (sell_price < {PROMO_THRESHOLD} * median_price) AS promo_days, max(median_price) AS median_price
  FROM panel JOIN med USING (id) WHERE sell_price IS NOT NULL GROUP BY id
),
chosen AS (
  SELECT *, promo / base AS lift FROM cand
  WHERE base >= {X.PROMO_MIN_BASE} AND promo_days BETWEEN {X.PROMO_DAYS[0]} AND {X.PROMO_DAYS[1]} AND median_price >= {X.PROMO_MIN_PRICE}
)"""
_CAND_SELECT = f"id, {rr('base', 'promo', 'median_price', 'lift')}, promo_days"
_BINS = X.HISTOGRAM_BINS

ENTRIES: dict[str, Entry] = {
    "ed_daily_totals": entry(
        _daily,
        with_panel(f"SELECT CAST(date AS VARCHAR) AS date, {big('sales', 'dow', 'month')} FROM tot", _DAILY_CTE),
    ),
    "ed_smoothed_totals": entry(
        lambda s, sf: X.smoothed_totals(_daily(s, sf)),
        with_panel(
            f"SELECT CAST(date AS VARCHAR) AS date, sales, "
            f"{r(f'CASE WHEN count(*) {_CENTRED} = 28 THEN avg(sales) {_CENTRED} END', 'centred_mean')}, "
            "CAST(month = 12 AND day(date) = 25 AS BIGINT) AS is_christmas FROM tot",
            _DAILY_CTE,
        ),
    ),
    "ed_by_weekday": entry(
        lambda s, sf: X.mean_by(_daily(s, sf), "dow"),
        with_panel(f"SELECT {big('dow')}, {r('avg(sales)', 'mean_sales')} FROM tot GROUP BY tot.dow", _DAILY_CTE),
    ),
    "ed_by_month": entry(
        lambda s, sf: X.mean_by(_daily(s, sf), "month"),
        with_panel(f"SELECT {big('month')}, {r('avg(sales)', 'mean_sales')} FROM tot GROUP BY tot.month", _DAILY_CTE),
    ),
    "ed_flag_effect": entry(
        lambda s, sf: X.flag_effect(retail.panel(s, sf), ("cat_id", "state_id")),
        with_panel(
            f"SELECT cat_id, state_id, {rr('mean_off', 'mean_on')}, "
            f"{r('100 * (mean_on / nullif(mean_off, 0) - 1)', 'lift_pct')} FROM (SELECT cat_id, state_id, "
            "avg(sales) FILTER (snap = 0) AS mean_off, avg(sales) FILTER (snap = 1) AS mean_on FROM panel GROUP BY cat_id, state_id)"
        ),
    ),
    "ed_event_windows": entry(
        lambda s, sf: X.event_windows(panel_table(s, sf), X.daily_totals(panel_table(s, sf)), EVENT_NAMES),
        with_panel(
            f"""SELECT event_name, CAST(k AS BIGINT) AS offset, {r('avg(sales)', 'mean_sales')} FROM (
              SELECT event_name, e, k, sales, count(*) OVER (PARTITION BY event_name, e) AS n
              FROM (SELECT DISTINCT event_name_1 AS event_name, date AS e FROM panel WHERE event_name_1 IS NOT NULL) x
              CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range({-X.EVENT_DAYS}, {X.EVENT_DAYS + 1}))
              JOIN tot ON tot.date = e + k) WHERE n = {2 * X.EVENT_DAYS + 1} GROUP BY event_name, k""",
            _DAILY_CTE,
        ),
    ),
    "ed_zero_fractions": entry(
        lambda s, sf: X.zero_fractions(retail.panel(s, sf)),
        with_panel(f"SELECT id, {rr('zero_frac')} FROM zero", _ZERO_CTE),
    ),
    "ed_median_zero_fraction": entry(
        lambda s, sf: X.median_zero_fraction(X.zero_fractions(retail.panel(s, sf))),
        with_panel(f"SELECT {r('median(zero_frac)', 'median_zero_frac')} FROM zero", _ZERO_CTE),
    ),
    "ed_zero_histogram": entry(
        lambda s, sf: X.zero_histogram(X.zero_fractions(panel_table(s, sf))),
        with_panel(
            f"SELECT CAST(least(floor((zero_frac - lo) / nullif(hi - lo, 0) * {_BINS}), {_BINS - 1}) AS BIGINT) AS bin, "
            "count(*) AS n_series FROM zero CROSS JOIN (SELECT min(zero_frac) AS lo, max(zero_frac) AS hi FROM zero) GROUP BY 1",
            _ZERO_CTE,
        ),
    ),
    "ed_store_category": entry(
        _store_category,
        with_panel(
            "SELECT store_id, "
            + ", ".join(r(f"avg(sales) FILTER (cat_id = '{c}')", c.lower()) for c in CATEGORIES)
            + " FROM panel GROUP BY store_id"
        ),
    ),
    "ed_promo_candidates": entry(
        lambda s, sf: X.promo_candidates(retail.panel(s, sf)),
        with_panel(f"SELECT {_CAND_SELECT} FROM chosen", _CANDIDATE_CTE),
    ),
    "ed_promo_exemplar": entry(
        lambda s, sf: X.promo_exemplar(retail.panel(s, sf)),
        with_panel(f"SELECT {_CAND_SELECT} FROM chosen ORDER BY chosen.lift DESC, id LIMIT 1", _CANDIDATE_CTE),
    ),
    "ed_exemplar_view": entry(
        _exemplar_view,
        with_panel(
            f"""SELECT id, CAST(date AS VARCHAR) AS date, {r('CASE WHEN count(*) OVER w = 7 THEN avg(sales) OVER w END', 'centred_mean')},
            {rr('sell_price')} FROM panel WHERE id = (SELECT id FROM chosen ORDER BY lift DESC, id LIMIT 1)
            WINDOW w AS (PARTITION BY id ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
            _CANDIDATE_CTE,
        ),
    ),
    "ed_headline": entry(
        lambda s, sf: X.headline(panel_table(s, sf)),
        with_panel(
            f"""SELECT {r('(SELECT round(avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END), 4) FROM panel)', 'zero_sales_frac')},
            {r('(SELECT round(median(zero_frac), 4) FROM zero)', 'median_series_zero_frac')},
            {r('round(avg(sales) FILTER (dow >= 5) / avg(sales) FILTER (dow IN (1, 2)) - 1, 4)', 'weekend_vs_midweek_lift')},
            {r('round(avg(sales) FILTER (month = 12 AND day(date) = 25) / avg(sales), 4)', 'christmas_vs_avg_day')} FROM tot""",
            _DAILY_CTE,
            _ZERO_CTE,
        ),
    ),
}
