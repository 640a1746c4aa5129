"""The full feature table: panel columns, then 35 features in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from demandloom.operators import calendar, features, price
from demandloom.operators.panel import PANEL_COLS

# Identity, keys and the raw target are no model inputs.
NON_FEATURES = frozenset(PANEL_COLS) - {"sell_price", "snap"}

FEATURE_COLS = [
    *[f"sales_lag_{lag}" for lag in features.LAGS],
    *[f"r_{stat}_{w}" for w in features.WINDOWS for stat in features.STATS],
    *[features.ewm_name(a) for a in features.EWM_ALPHAS],
    "hist_mean", "momentum_7_28",
    "dow", "is_weekend", "dom", "week", "month", "year", "is_christmas",
    "days_to_event", "days_since_event", "is_event",
    "price_chg_7", "price_rel_med", "is_promo", "price_rel_dept",
]


def build_features(panel: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """All feature families on one panel.

    The shelf price shuffles on (store, department, day) and runs first, while
    rows are narrow. Everything after it shares one shuffle on ``id``, which is
    also how the result leaves.
    """
    out = price.shelf_price(panel)
    out = price.promotion(price.week_change(out))
    out = features.target_features(out)
    out = calendar.calendar_features(out, events)
    return out.select(*PANEL_COLS, *FEATURE_COLS)


def numeric_feature_columns(df: DataFrame) -> list[str]:
    """The model inputs of a feature table, in column order."""
    return [c for c in df.columns if c not in NON_FEATURES]
