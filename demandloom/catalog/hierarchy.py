"""Hierarchy and reconciliation queries."""

from __future__ import annotations

from demandloom.catalog.base import (
    FOLDS,
    HORIZON,
    TEST_ROWS,
    TRAIN_END,
    Entry,
    big,
    entry,
    r,
    rr,
    with_forecasts,
    with_panel,
)
from demandloom.operators import hierarchy as H
from demandloom.operators import mint as MT
from demandloom.operators.panel import ID_COLS, day_slice, series_dimension
from demandloom.plans import retail
from demandloom.plans.backtest import baseline_forecasts
from demandloom.plans.stages import panel_table
from demandloom.session import cut_lineage

BASE_DAYS = 28
_LEAF_MODEL = "seasonal_naive_7"


def _key_sql(columns: tuple[str, ...]) -> str:
    return " || '|' || ".join(columns) if columns else f"'{H.TOTAL_KEY}'"


def _bridge_sql(levels, source: str) -> str:
    last = len(levels) - 1
    return " UNION ALL ".join(
        f"SELECT {no} AS level_no, '{name}' AS level, {'id' if no == last else _key_sql(keys)} AS key, id FROM {source}"
        for no, (name, keys) in enumerate(levels)
    )


BRIDGE_CTE = f"br AS ({_bridge_sql(H.LEVELS, 'ids')})"


def meta(spark, sf):
    return series_dimension(day_slice(panel_table(spark, sf), None, TRAIN_END, ID_COLS))


def _dimension(spark, sf):
    return series_dimension(retail.daily_sales(spark, sf))


def _test(spark, sf):
    return day_slice(panel_table(spark, sf), TRAIN_END + 1, TRAIN_END + HORIZON, [*ID_COLS, "d", "sales"])


def _sales(spark, sf):
    return retail.panel(spark, sf).select(*ID_COLS, "d", "sales")


def _leaf_forecast(spark, sf):
    return baseline_forecasts(panel_table(spark, sf), FOLDS[-1:], [_LEAF_MODEL]).select("id", "d", "yhat")


def base(spark, sf):
    """Upper nodes flat, leaves seasonal: they do not add up."""
    return H.flat_node_base(_recent(spark, sf), _leaf_forecast(spark, sf), TRAIN_END, HORIZON, BASE_DAYS)


def _recent(spark, sf):
    return day_slice(panel_table(spark, sf), TRAIN_END - BASE_DAYS + 1, TRAIN_END, [*ID_COLS, "d", "sales"])


def _shares(spark, sf):
    return H.proportions(_recent(spark, sf))


def _reconciled(spark, sf):
    known, dimension = base(spark, sf), meta(spark, sf)
    return {
        "base": known,
        "bottom_up": H.bottom_up(known, dimension),
        "top_down": H.top_down(known, _shares(spark, sf), dimension),
    }


def _level_wape(spark, sf):
    actual = H.aggregate(_test(spark, sf), ["sales"])
    return H.level_wape(H.stack(_reconciled(spark, sf)), actual)


def _coherence(spark, sf):
    errors = {m: H.coherence_error(v, meta(spark, sf)) for m, v in _reconciled(spark, sf).items()}
    return H.stack(errors)


# ---- the upper levels, whose leaves are store x department ----


def _upper(spark, sf):
    """(meta, leaf history, node history, base) of the nine upper levels.

    All are read many times, and small beside the panel: the panel is passed over once for each.
    """
    series = cut_lineage(meta(spark, sf))
    dimension = cut_lineage(H.shelf_meta(series))
    history = cut_lineage(H.regroup_to_shelves(_recent(spark, sf), ["sales"]))
    leaf = H.regroup_to_shelves(H.with_keys(_leaf_forecast(spark, sf), series), ["yhat"]).select("id", "d", "yhat")
    known = cut_lineage(H.flat_node_base(history, leaf, TRAIN_END, HORIZON, BASE_DAYS, H.UPPER_LEVELS))
    nodes = cut_lineage(H.aggregate(history, ["sales"], ("d",), H.UPPER_LEVELS))
    return dimension, history, nodes, known


def _mint(spark, sf, shrink):
    dimension, _, nodes, known = _upper(spark, sf)
    weights = H.residual_variance(nodes)
    residuals = H.residuals(nodes) if shrink else None
    return known, dimension, weights, MT.mint(known, dimension, weights, H.UPPER_LEVELS, shrink, residuals)


def _mint_optimality(spark, sf):
    known, dimension, weights, made = _mint(spark, sf, 0.0)
    return MT.optimality(known, made, dimension, weights, H.UPPER_LEVELS)


def _mint_coherence(spark, sf):
    _, dimension, _, made = _mint(spark, sf, 0.0)
    return H.coherence_error(made, dimension, ("d",), H.UPPER_LEVELS)


def _mint_all_levels(spark, sf):
    dimension, known = meta(spark, sf), base(spark, sf)
    weights = H.residual_variance(H.aggregate(_recent(spark, sf), ["sales"]))
    made = MT.mint(known, dimension, weights)
    return MT.optimality(known, made, dimension, weights)


def _upper_wape(spark, sf):
    dimension, history, nodes, known = _upper(spark, sf)
    weights = H.residual_variance(nodes)
    actual = H.aggregate(
        H.regroup_to_shelves(_test(spark, sf), ["sales"]), ["sales"], ("d",), H.UPPER_LEVELS
    )
    methods = {
        "base": known,
        "bottom_up": H.bottom_up(known, dimension, ("d",), H.UPPER_LEVELS),
        "top_down": H.top_down(known, H.proportions(history), dimension, H.UPPER_LEVELS),
        "mint_diag": MT.mint(known, dimension, weights, H.UPPER_LEVELS),
        "mint_shrink": MT.mint(known, dimension, weights, H.UPPER_LEVELS, _SHRINK, H.residuals(nodes)),
    }
    return H.mean_level_wape(H.level_wape(H.stack(methods), actual))


# ---- SQL ----

_RECENT_SQL = f"d > {TRAIN_END - BASE_DAYS} AND d <= {TRAIN_END}"
_BASE_CTES = (
    BRIDGE_CTE,
    f"""
recent AS (
  SELECT level, key, d, sum(sales) AS sales FROM panel JOIN br USING (id) WHERE {_RECENT_SQL} GROUP BY level, key, d
),
leaffc AS (SELECT id, d, yhat FROM fc WHERE fold = {FOLDS[-1].fold_id} AND model = '{_LEAF_MODEL}'),
horizon AS (SELECT CAST(range AS INTEGER) AS d FROM range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1})),
base AS (
  SELECT level, key, h.d, yhat FROM (
    SELECT level, key, avg(sales) AS yhat FROM recent WHERE level <> 'item_store' GROUP BY level, key) CROSS JOIN horizon h
  UNION ALL SELECT 'item_store', id, d, yhat FROM leaffc
),
bu AS (SELECT level, key, d, sum(yhat) AS yhat FROM leaffc JOIN br USING (id) GROUP BY level, key, d),
share AS (
  SELECT id, avg(sales) / nullif(sum(avg(sales)) OVER (), 0) AS share FROM panel WHERE {_RECENT_SQL} GROUP BY id
),
td AS (
  SELECT b.level, b.key, t.d, sum(share * t.yhat) AS yhat
  FROM share JOIN br b USING (id) CROSS JOIN (SELECT d, yhat FROM base WHERE level = 'total') t GROUP BY b.level, b.key, t.d
),
actual AS (SELECT level, key, d, sum(sales) AS sales FROM {TEST_ROWS} t JOIN br USING (id) GROUP BY level, key, d),
methods AS (
  SELECT 'base' AS method, * FROM base UNION ALL SELECT 'bottom_up', * FROM bu UNION ALL SELECT 'top_down', * FROM td
)""",
)
_NODE = "level, key, " + big("d")
_SHELVES = "shelf AS (SELECT DISTINCT store_id || '|' || dept_id AS id, state_id, store_id, cat_id, dept_id FROM ids)"

_SHELF = H.UPPER_LEVELS[-1][0]
_SHRINK = 0.5


def _sweep(name: str, rows: str, size: str) -> str:
    """Gauss-Jordan steps over the rows (i, v) of an augmented positive definite system."""
    return f"""
{name}(i, v, k) AS (
  SELECT i, v, 1 FROM {rows}
  UNION ALL
  SELECT i, CASE WHEN i = k THEN list_transform(v, lambda e: e / top[k])
                 ELSE list_transform(v, lambda e, j: e - v[k] / top[k] * top[j]) END, k + 1
  FROM (SELECT *, any_value(CASE WHEN i = k THEN v END) OVER () AS top FROM {name}) WHERE k <= {size}
)"""


def _mint_ctes(name: str, variance: str, factor: float) -> str:
    """``name`` (level, key, d, yhat): the dense solution with W = diag(variance) + factor R R'."""
    return f"""
w_{name} AS MATERIALIZED (SELECT level, key, {variance} AS w FROM urecent GROUP BY level, key),
m_{name} AS (
  SELECT i, j, sum(m) AS m FROM (
    SELECT a.i, b.i AS j, w.w AS m FROM uleaf a JOIN uleaf b USING (id) JOIN w_{name} w ON w.level = '{_SHELF}' AND w.key = a.id
    UNION ALL SELECT i, i, w FROM unum JOIN w_{name} USING (level, key)
    UNION ALL SELECT a.i, b.i, {factor} * a.r * b.r FROM uresid a JOIN uresid b USING (t))
  GROUP BY i, j
),
rows_{name} AS MATERIALIZED (
  SELECT i, list_concat(v, g) AS v
  FROM (SELECT i, list(coalesce(m, 0.0::DOUBLE) ORDER BY j) AS v
        FROM (SELECT a.i, b.i AS j FROM unum a CROSS JOIN unum b) LEFT JOIN m_{name} USING (i, j) GROUP BY i)
  JOIN (SELECT i, list(g ORDER BY d) AS g FROM ugap GROUP BY i) USING (i)
),{_sweep(f"sweep_{name}", f"rows_{name}", "(SELECT count(*) FROM unum)")},
x_{name} AS MATERIALIZED (
  SELECT i, {TRAIN_END} + h AS d, v[n + h] AS x
  FROM sweep_{name} CROSS JOIN (SELECT count(*) AS n FROM unum) CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(1, {HORIZON + 1}))
  WHERE k = n + 1
),
leaf_{name} AS (
  SELECT id, d, b.yhat + w.w * pull - coalesce(shift, 0) AS yhat
  FROM (SELECT level, key AS id, d, yhat FROM ubase WHERE level = '{_SHELF}') b JOIN w_{name} w ON w.level = b.level AND w.key = b.id
  JOIN (SELECT id, d, sum(x) AS pull FROM uleaf JOIN x_{name} USING (i) GROUP BY id, d) p USING (id, d)
  LEFT JOIN (
    SELECT c.key AS id, d, {factor} * sum(c.r * g) AS shift FROM ucentred c
    JOIN (SELECT t, d, sum(r * x) AS g FROM uresid JOIN x_{name} USING (i) GROUP BY t, d) z ON z.t = c.d_of
    WHERE c.level = '{_SHELF}' GROUP BY c.key, d) q USING (id, d)
),
{name} AS MATERIALIZED (SELECT level, key, d, sum(yhat) AS yhat FROM leaf_{name} JOIN ubr USING (id) GROUP BY level, key, d)"""


_MINT_CTES = (
    *_BASE_CTES,
    _SHELVES,
    f"""
ubr AS MATERIALIZED ({_bridge_sql(H.UPPER_LEVELS, "shelf")}),
urecent AS MATERIALIZED (
  SELECT level, key, d, sum(sales) AS sales FROM panel JOIN ubr ON ubr.id = store_id || '|' || dept_id WHERE {_RECENT_SQL} GROUP BY level, key, d
),
ubase AS MATERIALIZED (
  SELECT level, key, d, mean AS yhat FROM (SELECT level, key, sum(sales) / {BASE_DAYS}.0 AS mean FROM urecent WHERE level <> '{_SHELF}' GROUP BY level, key)
  CROSS JOIN horizon
  UNION ALL
  SELECT '{_SHELF}', store_id || '|' || dept_id, f.d, sum(yhat) FROM leaffc f JOIN ids USING (id) GROUP BY 1, 2, 3
),
unum AS MATERIALIZED (
  SELECT level, key, row_number() OVER (ORDER BY level, key) AS i FROM (SELECT DISTINCT level, key FROM ubr WHERE level <> '{_SHELF}')
),
uleaf AS MATERIALIZED (SELECT i, id FROM unum JOIN ubr USING (level, key)),
ugap AS MATERIALIZED (
  SELECT i, b.d AS d, any_value(b.yhat) - sum(l.yhat) AS g FROM unum JOIN ubase b USING (level, key) JOIN uleaf USING (i)
  JOIN ubase l ON l.level = '{_SHELF}' AND l.key = id AND l.d = b.d GROUP BY i, b.d
),
ucentred AS MATERIALIZED (SELECT level, key, d AS d_of, sales - avg(sales) OVER (PARTITION BY level, key) AS r FROM urecent),
uresid AS MATERIALIZED (
  SELECT i, b.d_of AS t, any_value(b.r) - sum(l.r) AS r FROM unum JOIN ucentred b USING (level, key) JOIN uleaf USING (i)
  JOIN ucentred l ON l.level = '{_SHELF}' AND l.key = id AND l.d_of = b.d_of GROUP BY i, b.d_of
)""",
)
_DIAGONAL = _mint_ctes("mint_diag", f"var_pop(sales) + {H.VARIANCE_FLOOR}", 0.0)
_SHRUNK = _mint_ctes(
    "mint_shrink", f"(var_pop(sales) * {BASE_DAYS} / {BASE_DAYS - 1} + {H.VARIANCE_FLOOR}) * {_SHRINK}", (1 - _SHRINK) / (BASE_DAYS - 1)
)
_UPPER_METHODS = f"""
uleaffc AS (SELECT key AS id, d, yhat FROM ubase WHERE level = '{_SHELF}'),
ushare AS (
  SELECT key AS id, avg(sales) / nullif(sum(avg(sales)) OVER (), 0) AS share FROM urecent WHERE level = '{_SHELF}' GROUP BY key
),
umethods AS (
  SELECT 'base' AS method, level, key, d, yhat FROM ubase
  UNION ALL SELECT 'bottom_up', level, key, d, sum(yhat) FROM uleaffc JOIN ubr USING (id) GROUP BY level, key, d
  UNION ALL SELECT 'top_down', u.level, u.key, t.d, sum(share * t.yhat)
    FROM ushare JOIN ubr u USING (id) CROSS JOIN (SELECT d, yhat FROM ubase WHERE level = 'total') t GROUP BY u.level, u.key, t.d
  UNION ALL SELECT 'mint_diag', * FROM mint_diag
  UNION ALL SELECT 'mint_shrink', * FROM mint_shrink
),
uactual AS (
  SELECT level, key, d, sum(sales) AS sales FROM {TEST_ROWS} t JOIN ubr ON ubr.id = store_id || '|' || dept_id GROUP BY level, key, d
)"""


def _recursive(select: str, *ctes: str) -> str:
    return with_forecasts(select, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


ENTRIES: dict[str, Entry] = {
    "hi_nodes": entry(
        lambda s, sf: H.nodes(_dimension(s, sf)),
        with_panel(
            "SELECT level, key, row_number() OVER (ORDER BY level_no, key) - 1 AS node_idx "
            "FROM (SELECT DISTINCT level_no, level, key FROM br)",
            BRIDGE_CTE,
        ),
    ),
    "hi_bridge": entry(
        lambda s, sf: H.bridge(_dimension(s, sf)).drop("level_no"), with_panel("SELECT level, key, id FROM br", BRIDGE_CTE)
    ),
    "hi_level_sizes": entry(
        lambda s, sf: H.level_sizes(_dimension(s, sf)),
        with_panel("SELECT level, count(DISTINCT key) AS n_nodes FROM br GROUP BY level", BRIDGE_CTE),
    ),
    "hi_aggregate": entry(
        lambda s, sf: H.aggregate(_sales(s, sf), ["sales"]),
        with_panel(
            f"SELECT level, key, {big('d')}, CAST(sum(sales) AS BIGINT) AS sales FROM panel JOIN br USING (id) GROUP BY level, key, panel.d",
            BRIDGE_CTE,
        ),
    ),
    "hi_flat_node_base": entry(base, with_forecasts(f"SELECT {_NODE}, {rr('yhat')} FROM base", *_BASE_CTES)),
    "hi_bottom_up": entry(
        lambda s, sf: _reconciled(s, sf)["bottom_up"], with_forecasts(f"SELECT {_NODE}, {rr('yhat')} FROM bu", *_BASE_CTES)
    ),
    "hi_proportions": entry(_shares, with_forecasts(f"SELECT id, {rr('share')} FROM share", *_BASE_CTES)),
    "hi_top_down": entry(
        lambda s, sf: _reconciled(s, sf)["top_down"], with_forecasts(f"SELECT {_NODE}, {rr('yhat')} FROM td", *_BASE_CTES)
    ),
    "hi_coherence_error": entry(
        _coherence,
        with_forecasts(
            f"""SELECT m.method, {r('max(abs(m.yhat - i.yhat))', 'coherence_error')}
            FROM methods m JOIN (SELECT method, br.level, br.key, d, sum(yhat) AS yhat
              FROM methods JOIN br ON methods.level = 'item_store' AND methods.key = br.id GROUP BY method, br.level, br.key, d) i
            USING (method, level, key, d) GROUP BY m.method""",
            *_BASE_CTES,
        ),
    ),
    "hi_level_wape": entry(
        _level_wape,
        with_forecasts(
            f"SELECT method, level, {r('sum(abs(yhat - sales)) / nullif(sum(abs(sales)), 0)', 'wape')} "
            "FROM methods JOIN actual USING (level, key, d) GROUP BY method, level",
            *_BASE_CTES,
        ),
    ),
    "hi_mean_level_wape": entry(
        lambda s, sf: H.mean_level_wape(_level_wape(s, sf)),
        with_forecasts(
            f"SELECT method, {r('avg(wape)', 'mean_wape')} FROM (SELECT method, level, "
            "sum(abs(yhat - sales)) / nullif(sum(abs(sales)), 0) AS wape "
            "FROM methods JOIN actual USING (level, key, d) GROUP BY method, level) GROUP BY method",
            *_BASE_CTES,
        ),
    ),
    "hi_shelf_leaves": entry(
        lambda s, sf: H.regroup_to_shelves(_sales(s, sf), ["sales"]),
        with_panel(
            "SELECT store_id || '|' || dept_id AS id, state_id, store_id, cat_id, dept_id, CAST(d AS BIGINT) AS d, "
            "CAST(sum(sales) AS BIGINT) AS sales FROM panel GROUP BY ALL"
        ),
    ),
    "hi_residual_variance": entry(
        lambda s, sf: H.residual_variance(H.aggregate(_recent(s, sf), ["sales"])),
        with_forecasts(
            f"SELECT level, key, {r(f'var_pop(sales) + {H.VARIANCE_FLOOR}', 'variance')} FROM recent GROUP BY level, key",
            *_BASE_CTES,
        ),
    ),
    "hi_mint_diag": entry(
        lambda s, sf: _mint(s, sf, 0.0)[3], _recursive(f"SELECT {_NODE}, {rr('yhat')} FROM mint_diag", *_MINT_CTES, _DIAGONAL)
    ),
    "hi_mint_shrink": entry(
        lambda s, sf: _mint(s, sf, _SHRINK)[3], _recursive(f"SELECT {_NODE}, {rr('yhat')} FROM mint_shrink", *_MINT_CTES, _SHRUNK)
    ),
    "hi_mint_optimality": entry(
        _mint_optimality,
        with_panel(
            f"SELECT id AS key, CAST(range AS BIGINT) AS d, 0.0::DOUBLE AS imbalance "
            f"FROM shelf CROSS JOIN range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1})",
            _SHELVES,
        ),
    ),
    "hi_mint_coherence": entry(
        _mint_coherence, with_panel("SELECT 0.0::DOUBLE AS coherence_error FROM (SELECT count(*) FROM panel)")
    ),
    "hi_mint_all_levels": entry(
        _mint_all_levels,
        with_panel(
            f"SELECT id AS key, CAST(range AS BIGINT) AS d, 0.0::DOUBLE AS imbalance "
            f"FROM ids CROSS JOIN range({TRAIN_END + 1}, {TRAIN_END + HORIZON + 1})"
        ),
    ),
    "hi_upper_methods_wape": entry(
        _upper_wape,
        _recursive(
            f"SELECT method, {r('avg(wape)', 'mean_wape')} FROM (SELECT method, level, "
            "sum(abs(yhat - sales)) / nullif(sum(abs(sales)), 0) AS wape "
            "FROM umethods JOIN uactual USING (level, key, d) GROUP BY method, level) GROUP BY method",
            *_MINT_CTES, _DIAGONAL, _SHRUNK, _UPPER_METHODS,
        ),
    ),
}
