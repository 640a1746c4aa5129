"""Raw files to panel, features, forecast and scores in one go."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import hierarchy as H
from demandloom.operators import panel as P
from demandloom.plans.backtest import backtest, baseline_forecasts, holdout, score_levels
from demandloom.operators.metrics import expanding_folds
from demandloom.plans.features import FEATURE_COLS, build_features
from demandloom.sources import raw, tables

DAYS = 133


def test_raw_files_to_scores(spark, tmp_path):
    rng = np.random.default_rng(77)
    day_cols = ",".join(f"d_{d}" for d in range(1, DAYS + 1))
    sales = ["id,item_id,dept_id,cat_id,store_id,state_id," + day_cols]
    for store, state, cat in (("N_2", "N", "HOME"), ("S_4", "S", "LIGHT"), ("S_5", "S", "HOME")):
        for k in (1, 2):
            item = f"{cat}_1_{k}"
            units = ",".join(str(v) for v in rng.poisson(2 + 3 * k, DAYS))
            sales.append(f"{item}_{store},{item},{cat}_1,{cat},{store},{state},{units}")
    calendar = ["d,date,wm_yr_wk,event_name_1,event_type_1,event_name_2,event_type_2,snap_N,snap_S"]
    weeks = set()
    for d in range(1, DAYS + 1):
        week = 300 + (d + 2) // 7
        weeks.add(week)
        calendar.append(f"d_{d},{dt.date(2018, 3, 14) + dt.timedelta(days=d)},{week},,,,,{rng.integers(0, 2)},{rng.integers(0, 2)}")
    prices = ["store_id,item_id,wm_yr_wk,sell_price"]
    prices += [f"{s},{c}_1_{k},{w},{rng.integers(200, 900) / 100}" for s, c in (("N_2", "HOME"), ("S_4", "LIGHT"), ("S_5", "HOME")) for k in (1, 2) for w in sorted(weeks)]
    for name, lines in (("sales", sales), ("calendar", calendar), ("prices", prices)):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")

    panel = P.assemble(
        raw.load_sales(spark, str(tmp_path / "sales.csv")),
        raw.load_calendar(spark, str(tmp_path / "calendar.csv")),
        raw.load_prices(spark, str(tmp_path / "prices.csv")),
    )
    assert P.validate(panel, 6, DAYS).first().price_missing_frac == 0.0
    tables.write_panel(panel, str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))

    tables.write_features(build_features(stored), str(tmp_path / "features"))
    features = tables.read_features(spark, str(tmp_path / "features"))
    assert set(FEATURE_COLS) < set(features.columns) and features.count() == 6 * DAYS

    end = DAYS - 28
    fold = expanding_folds(1, 28, DAYS)
    point = backtest(stored, fold, ["moving_avg_28"]).first()
    assert point.n == 6 * 28 and 0 < point.wape < 2
    forecasts = baseline_forecasts(stored, fold, ["moving_avg_28"])
    scores = {r.level: r.wrmsse for r in score_levels(stored, forecasts.drop("fold"), end, 28).collect()}
    assert set(scores) == {n for n, _ in H.LEVELS} | {"overall"}
    assert all(np.isfinite(v) and v > 0 for v in scores.values())
    assert holdout(stored, ["moving_avg_28"], end, 28).first().wrmsse == pytest.approx(scores["overall"])
    assert stored.agg(F.sum("sales")).first()[0] > 0
