"""Training-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.catalog.base import HORIZON, LAST_DAY, TRAIN_END, Entry, big, entry, r, with_panel
from demandloom.operators import training_windows as TW
from demandloom.operators.panel import series_dimension
from demandloom.plans import retail
from demandloom.plans.stages import feature_table

CONTEXT = TW.CONTEXT_DAYS
SEEDED_DRAWS_PER_SERIES = 2
STARTS = (CONTEXT, 1000, TRAIN_END - HORIZON)
_COV_NAMES = [f"cov_{name}" for name in TW.COVARIATES]


def _arrays(spark, sf):
    return TW.series_arrays(feature_table(spark, sf))


def _array_rows(spark, sf):
    both = F.arrays_zip("sales", "covs")
    rows = _arrays(spark, sf).select("id", "first_day", F.posexplode(both).alias("pos", "day"))
    covs = [F.col("day.covs")[i].alias(name) for i, name in enumerate(_COV_NAMES)]
    return rows.select("id", (F.col("first_day") + F.col("pos")).alias("d"), F.col("day.sales").alias("sales"), *covs)


def _codes(spark, sf):
    return TW.dense_codes(series_dimension(retail.daily_sales(spark, sf)))


def _draws(spark, sf):
    weights = TW.series_weights(retail.panel(spark, sf).select("id", "d", "sales"), TRAIN_END)
    n = SEEDED_DRAWS_PER_SERIES * weights.count()
    return TW.sample_windows(weights, n, TRAIN_END)


def _draw_checks(spark, sf):
    dimension = series_dimension(retail.daily_sales(spark, sf)).select("id", F.lit(True).alias("known"))
    draws = _draws(spark, sf).join(dimension, "id", "left")
    return draws.agg(
        F.count("*").alias("draws"),
        F.countDistinct("draw").alias("distinct_draws"),
        F.count_if(~F.col("start").between(CONTEXT, TRAIN_END - HORIZON - 1)).alias("bad_starts"),
        F.count_if(F.col("known").isNull()).alias("unknown_series"),
    )


def _window_rows(windows, keys):
    both = F.arrays_zip("past", "past_scaled")
    return windows.select(*keys, "nu", F.element_at("target", HORIZON).alias("last_target"), F.posexplode(both).alias("pos", "day")).select(
        *keys, "nu", "last_target", "pos", F.col("day.past").alias("past"), F.col("day.past_scaled").alias("past_scaled")
    )


def _sampled_windows(spark, sf):
    return _window_rows(TW.cut_windows(_arrays(spark, sf), _draws(spark, sf)), ["draw", "id", "start"])


def _windows(spark, sf):
    arrays = _arrays(spark, sf)
    draws = arrays.select("id", F.explode(F.array(*[F.lit(s) for s in STARTS])).alias("start"))
    return _window_rows(TW.cut_windows(arrays, draws), ["id", "start"])


def _inference(spark, sf):
    """The last window of every series, with the covariates of its future days."""
    arrays = TW.series_arrays(TW.blank_after(feature_table(spark, sf), TRAIN_END))
    made = TW.inference_windows(arrays, TRAIN_END)
    days = F.posexplode("future_covs").alias("pos", "covs")
    rows = made.select("id", "nu", F.aggregate("target", F.lit(0.0), lambda a, x: a + x).alias("future_sales"), days)
    return rows.select(
        "id", "nu", "future_sales", "pos", *[F.col("covs")[i].alias(name) for i, name in enumerate(_COV_NAMES)]
    )


_COV_SQL = {
    "cov_dow": "(isodow(date) - 1) / 7.0",
    "cov_dom": "day(date) / 31.0",
    "cov_month": "month(date) / 12.0",
    "cov_snap": "snap",
    "cov_is_event": "CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END",
    "cov_price": "ln(1 + coalesce(sell_price, 0))",
}
_COVS = ", ".join(r(sql, name) for name, sql in _COV_SQL.items())


def _uniform_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST(draw AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0"


_SEED = 42
_DRAWS_CTE = f"""
volume AS (SELECT id, CAST(sum(sales) AS DOUBLE) / {TRAIN_END} + {TW.MIN_VOLUME} AS weight FROM panel WHERE d <= {TRAIN_END} GROUP BY id),
many AS (SELECT {SEEDED_DRAWS_PER_SERIES} * count(*) AS n FROM volume),
laid AS (
  SELECT id, weight / (SELECT sum(weight) FROM volume) * n AS width, sum(weight / (SELECT sum(weight) FROM volume) * n) OVER (ORDER BY id) AS upto
  FROM volume CROSS JOIN many
),
drawn AS (SELECT draw, {_uniform_sql(_SEED)} * n AS place, {_uniform_sql(_SEED + 1)} AS u FROM many CROSS JOIN LATERAL (SELECT unnest(range(n)) AS draw)),
draws AS MATERIALIZED (
  SELECT draw, id, {CONTEXT} + CAST(floor(u * {TRAIN_END - HORIZON - CONTEXT}) AS BIGINT) AS start
  FROM drawn JOIN laid ON place >= upto - width AND place < upto
)"""
_CUT_CTE = f"""
win AS (
  SELECT draw, id, start, 1 + avg(CASE WHEN d <= start THEN sales END) AS nu, max(CASE WHEN d = start + {HORIZON} THEN sales END) AS last_target
  FROM panel JOIN draws USING (id) WHERE d > start - {CONTEXT} AND d <= start + {HORIZON} GROUP BY draw, id, start
)"""

ENTRIES: dict[str, Entry] = {
    "tw_series_arrays": entry(
        _array_rows, with_panel(f"SELECT id, {big('d')}, {r('sales', 'sales')}, {_COVS} FROM panel")
    ),
    "tw_dense_codes": entry(
        _codes,
        with_panel(
            "SELECT id, "
            + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}_code" for c in ("item_id", "dept_id", "store_id"))
            + " FROM ids"
        ),
    ),
    "tw_blank_after": entry(
        lambda s, sf: TW.blank_after(retail.panel(s, sf).select("id", "d", "sales"), TRAIN_END),
        with_panel(f"SELECT id, {big('d')}, CAST(CASE WHEN d <= {TRAIN_END} THEN sales ELSE 0 END AS BIGINT) AS sales FROM panel"),
    ),
    "tw_series_weights": entry(
        lambda s, sf: TW.series_weights(retail.panel(s, sf).select("id", "d", "sales"), TRAIN_END),
        with_panel(f"SELECT id, {r(f'avg(sales) + {TW.MIN_VOLUME}', 'weight')} FROM panel WHERE d <= {TRAIN_END} GROUP BY id"),
    ),
    "tw_sample_windows": entry(_draws, with_panel(f"SELECT {big('draw', 'start')}, id FROM draws", _DRAWS_CTE)),
    "tw_cut_sampled_windows": entry(
        _sampled_windows,
        with_panel(
            f"SELECT draw, p.id, CAST(start AS BIGINT) AS start, {r('nu', 'nu')}, {r('last_target', 'last_target')}, "
            f"CAST(p.d - start + {CONTEXT} - 1 AS BIGINT) AS pos, {r('p.sales', 'past')}, {r('p.sales / nu', 'past_scaled')} "
            f"FROM panel p JOIN win w ON p.id = w.id AND p.d > start - {CONTEXT} AND p.d <= start",
            _DRAWS_CTE,
            _CUT_CTE,
        ),
    ),
    "tw_sample_checks": entry(
        _draw_checks,
        with_panel(
            f"SELECT {SEEDED_DRAWS_PER_SERIES} * count(*) AS draws, {SEEDED_DRAWS_PER_SERIES} * count(*) AS distinct_draws, "
            "CAST(0 AS BIGINT) AS bad_starts, CAST(0 AS BIGINT) AS unknown_series FROM ids"
        ),
    ),
    "tw_cut_windows": entry(
        _windows,
        with_panel(
            f"SELECT p.id, CAST(start AS BIGINT) AS start, {r('nu', 'nu')}, {r('last_target', 'last_target')}, "
            f"CAST(p.d - start + {CONTEXT} - 1 AS BIGINT) AS pos, {r('p.sales', 'past')}, {r('p.sales / nu', 'past_scaled')} "
            f"FROM panel p JOIN win w ON p.id = w.id AND p.d > start - {CONTEXT} AND p.d <= start",
            f"""win AS (
              SELECT id, start, 1 + avg(CASE WHEN d <= start THEN sales END) AS nu,
                     max(CASE WHEN d = start + {HORIZON} THEN sales END) AS last_target
              FROM panel CROSS JOIN (VALUES {", ".join(f"({s})" for s in STARTS)}) AS t(start)
              WHERE d > start - {CONTEXT} AND d <= start + {HORIZON} GROUP BY id, start)""",
        ),
    ),
    "tw_inference_windows": entry(
        _inference,
        with_panel(
            f"SELECT p.id, {r('nu', 'nu')}, 0.0::DOUBLE AS future_sales, CAST(d - {TRAIN_END + 1} AS BIGINT) AS pos, {_COVS} "
            f"FROM panel p JOIN win USING (id) WHERE d > {TRAIN_END} AND d <= {LAST_DAY}",
            f"win AS (SELECT id, 1 + avg(sales) AS nu FROM panel WHERE d > {TRAIN_END - CONTEXT} AND d <= {TRAIN_END} GROUP BY id)",
        ),
    ),
}
