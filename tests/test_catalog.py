"""Queries against DuckDB on the smallest data, and the driver contract.

By default one query per family runs; ALL_QUERIES=1 runs every one.
"""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as driver
from demandloom.catalog import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
SAMPLE = [
    "io_price_scan", "io_forecast_store", "pn_panel", "pn_violations", "pn_join_prices", "ft_lags", "ft_rolling_std",
    "cl_event_distances", "pr_promotion", "fc_all_baselines", "fc_quantiles", "tw_inference_windows", "tw_cut_sampled_windows", "hi_nodes",
    "hi_level_wape", "hi_mint_shrink", "me_backtest", "me_backtest_linear", "me_comparison_report", "me_weighted_rmsse", "an_error_taxonomy", "an_winner_share", "ed_event_windows",
    "ed_headline",
]
# Fitted trees and Tweedie models: unit tests compare these with slow versions.
WITHOUT_SQL = {
    "fc_boosted_trees", "fc_feature_importance", "fc_tweedie_reg", "fc_tweedie_trees", "fc_tweedie_importance",
    "io_importance_store", "me_backtest_trees", "me_holdout_trees",
}
CHOSEN = [n for n, e in ENTRIES.items() if e.sql] if os.environ.get("ALL_QUERIES") else SAMPLE

needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = ENTRIES[name].run(spark, SF_DIR).toPandas()
    expected = duck.sql(ENTRIES[name].sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    got, expected = (f[columns].sort_values(columns, ignore_index=True) for f in (got, expected))
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, rtol=0, atol=1e-9)


@needs_data
def test_flagship(spark):
    assert driver.entry(spark).columns == ["method", "level", "wape"]


def test_contract():
    queries, oracle = driver.queries(), driver.oracle_sql()
    assert set(oracle) <= set(queries) and all(callable(q) for q in queries.values())
    # of this catalog; the training-data queries have tests of their own
    assert {n for n, e in ENTRIES.items() if e.sql is None} == WITHOUT_SQL
