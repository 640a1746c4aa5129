"""Raw files to panel, on two drawn series over three weeks of five, five and two days."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import panel as P
from demandloom.sources import raw, tables

DAYS, WEEK_DAYS, EVENT_DAY = 12, 5, 4
START = dt.date(2016, 5, 3)
draw = np.random.default_rng(41)
NORTH_SALES = draw.poisson(1.5, DAYS).tolist()
# the lamp is not offered in the middle week and sells nothing there
SOUTH_SALES = [0 if WEEK_DAYS <= i < 2 * WEEK_DAYS else int(draw.poisson(2)) for i in range(DAYS)]
NORTH_FLAG, SOUTH_FLAG = draw.integers(0, 2, (2, DAYS)).tolist()
PRICES = {("N_1", "KETTLE", 501): 18.75, ("N_1", "KETTLE", 502): 17.5, ("N_1", "KETTLE", 503): 19.25,
          ("S_4", "LAMP", 501): 41.0, ("S_4", "LAMP", 503): 36.5}


def _week(i):
    return 501 + i // WEEK_DAYS


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    days = [f"d_{i}" for i in range(1, DAYS + 1)]
    sales = ["id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(days)]
    sales.append("KETTLE_N_1,KETTLE,HOME_2,HOME,N_1,N," + ",".join(map(str, NORTH_SALES)))
    sales.append("LAMP_S_4,LAMP,LIGHT_1,LIGHT,S_4,S," + ",".join(map(str, SOUTH_SALES)))
    (root / "sales.csv").write_text("\n".join(sales) + "\n")
    calendar = ["date,wm_yr_wk,weekday,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_N,snap_S"]
    for i in range(DAYS):
        event = "Harvest,Cultural" if i + 1 == EVENT_DAY else ","
        date = START + dt.timedelta(days=i)
        calendar.append(f"{date},{_week(i)},x,d_{i + 1},{event},,,{NORTH_FLAG[i]},{SOUTH_FLAG[i]}")
    (root / "calendar.csv").write_text("\n".join(calendar) + "\n")
    prices = ["store_id,item_id,wm_yr_wk,sell_price", *[f"{s},{i},{w},{p}" for (s, i, w), p in PRICES.items()]]
    (root / "prices.csv").write_text("\n".join(prices) + "\n")
    return root


@pytest.fixture(scope="module")
def panel(spark, files):
    return P.assemble(
        raw.load_sales(spark, str(files / "sales.csv")),
        raw.load_calendar(spark, str(files / "calendar.csv")),
        raw.load_prices(spark, str(files / "prices.csv")),
    ).cache()


def test_scans_are_typed_and_projected(spark, files):
    sales = raw.load_sales(spark, str(files / "sales.csv"))
    assert dict(sales.dtypes)[f"d_{DAYS}"] == "smallint"
    calendar = raw.load_calendar(spark, str(files / "calendar.csv"))
    assert "weekday" not in calendar.columns
    assert dict(calendar.dtypes)["date"] == "date" and dict(calendar.dtypes)["snap_S"] == "tinyint"
    assert dict(raw.load_prices(spark, str(files / "prices.csv")).dtypes)["sell_price"] == "float"


def test_missing_column_is_named(spark, files, tmp_path):
    (tmp_path / "bad.csv").write_text("id,d_1\nx,1\n")
    with pytest.raises(ValueError, match="store_id"):
        raw.load_sales(spark, str(tmp_path / "bad.csv"))


def test_melt_values(panel, rows):
    seen = rows(panel.where("id = 'KETTLE_N_1'").select("d", "sales"), "d")
    assert [r["sales"] for r in seen] == NORTH_SALES and [r["d"] for r in seen] == list(range(1, DAYS + 1))
    assert panel.columns == P.PANEL_COLS


def test_flag_of_own_state(panel, rows):
    for series, expected in (("KETTLE_N_1", NORTH_FLAG), ("LAMP_S_4", SOUTH_FLAG)):
        assert [r["snap"] for r in rows(panel.where(F.col("id") == series).select("d", "snap"), "d")] == expected


def test_unknown_state_gets_no_flag(spark):
    df = spark.createDataFrame([("W", 1)], "state_id string, snap_N int")
    assert P.own_state_flag(df).first().snap == 0


def test_event_and_weekly_price(panel, rows):
    for store, item in (("N_1", "KETTLE"), ("S_4", "LAMP")):
        seen = rows(panel.where(F.col("item_id") == item).select("d", "event_name_1", "sell_price"), "d")
        assert [r["d"] for r in seen if r["event_name_1"]] == [EVENT_DAY]
        assert [r["sell_price"] for r in seen] == [PRICES.get((store, item, _week(i))) for i in range(DAYS)]


@pytest.mark.parametrize("written", [False, True])
def test_valid_panel_gives_summary(spark, panel, tmp_path, written):
    path = str(tmp_path / "panel")
    row = (tables.write_checked_panel(panel, path, 2, DAYS) if written else P.validate(panel, 2, DAYS)).first()
    if written:
        assert spark.read.parquet(path).count() == 2 * DAYS
    assert (row.rows, row.series, row.days) == (2 * DAYS, 2, DAYS)
    assert row.date_range == f"{START} to {START + dt.timedelta(days=DAYS - 1)}"
    assert row.zero_sales_frac == round((NORTH_SALES + SOUTH_SALES).count(0) / (2 * DAYS), 4)
    assert row.price_missing_frac == round(WEEK_DAYS / (2 * DAYS), 4)


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda p: p.where("d <> 6"), "row count"),
        (lambda p: p.withColumn("sales", F.expr("if(d = 8, null, sales)")), "null sales"),
        (lambda p: p.withColumn("sales", F.expr("if(d = 11, -1, sales)")), "negative sales"),
        (lambda p: p.withColumn("sell_price", F.lit(None).cast("float")), "without a price"),
        (lambda p: p.withColumn("date", F.expr("if(d = 9, date_sub(date, 1), date)")), "distinct dates"),
    ],
)
def test_each_violation_is_reported(panel, tmp_path, change, message):
    with pytest.raises(P.PanelError, match=message) as found:
        P.validate(change(panel), 2, DAYS)
    with pytest.raises(P.PanelError) as seen:
        tables.write_checked_panel(change(panel), str(tmp_path / "panel"), 2, DAYS)
    assert str(seen.value) == str(found.value)


def test_all_violations_at_once(panel):
    broken = panel.withColumn("sales", F.expr("if(d = 11, -1, sales)")).withColumn("sell_price", F.lit(None).cast("float"))
    with pytest.raises(P.PanelError) as found:
        P.validate(broken, 5, DAYS)
    assert all(text in str(found.value) for text in ("row count", "negative", "without a price"))


def test_densify_fills_gaps(spark, rows):
    sparse = spark.createDataFrame([("a", 3, 5), ("a", 4, 1), ("b", 1, 2)], "id string, d int, sales long")
    dense = P.densify(sparse, 1, 5, {"sales": 0}, ["id"])
    assert [(r["id"], r["d"], r["sales"]) for r in rows(dense, "id", "d")] == [
        ("a", 1, 0), ("a", 2, 0), ("a", 3, 5), ("a", 4, 1), ("a", 5, 0),
        ("b", 1, 2), ("b", 2, 0), ("b", 3, 0), ("b", 4, 0), ("b", 5, 0),
    ]


@pytest.mark.parametrize("day", [0, 9, None])
def test_densify_refuses_rows_outside_the_span(spark, day):
    sparse = spark.createDataFrame([("a", day, 9), ("a", 2, 1)], "id string, d int, sales long")
    with pytest.raises(Exception, match="is outside 1 to 3"):
        P.densify(sparse, 1, 3, {"sales": 0}, ["id"]).collect()


def test_order_panel_keeps_days_beyond_the_folds(spark, tmp_path):
    """Line items before the first and after the last fold day stay in the panel, and the calendar covers them."""
    from demandloom.plans import retail

    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("test tables are absent")
    for name in ("part", "supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(source / f"{name}.parquet")
    lines = spark.read.parquet(str(source / "lineitem.parquet"))
    moved = [lines.where(f"l_orderkey % 9 = {k}").withColumn("l_shipdate", F.expr(f"l_shipdate + interval {days} day"))
             for k, days in ((1, 500), (2, -60))]
    lines.unionByName(moved[0]).unionByName(moved[1]).write.parquet(str(tmp_path / "lineitem.parquet"))
    units = spark.read.parquet(str(tmp_path / "lineitem.parquet")).agg(F.sum("l_quantity")).first()[0]
    first, last = retail.span(spark, str(tmp_path)).first()
    assert first < 1 and last > retail.LAST_FOLD_DAY
    panel = retail.panel(spark, str(tmp_path)).select("id", "d", "sales")
    assert panel.agg(F.sum("sales"), F.min("d"), F.max("d")).first()[:] == (units, first, last)
    assert retail.calendar(spark, str(tmp_path)).count() == last - first + 1


def test_stored_panel_prunes_blocks(spark, tmp_path):
    long = spark.range(1, 801).selectExpr("'a' AS id", "cast(id AS int) AS d", "id AS sales")
    tables.write_panel(long, str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    tail = P.day_slice(stored, 790, None, ["id", "d", "sales"])
    assert tail.count() == 11
    assert len(tail.inputFiles()) >= 1 and P.day_slice(stored, 100, 300).count() == 201
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d_block" in plan


def test_feature_store_partitions_and_pruning(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", "S1", 1, 0.5), ("a", "S1", 2, 1.5), ("b", "S2", 1, 2.5)], "id string, store_id string, d int, x double"
    )
    path = str(tmp_path / "features")
    tables.write_features(df, path)
    assert sorted(p.name for p in (tmp_path / "features").glob("store_id=*")) == ["store_id=S1", "store_id=S2"]
    assert tables.read_features(spark, path, ["id", "x"], min_day=2).collect() == [("a", 1.5)]
    assert tables.read_features(spark, path, ["id"], stores=["S2"]).collect() == [("b",)]


def test_recent_features_open_recent_folders_only(spark, tmp_path):
    path = str(tmp_path / "features")
    days = spark.range(1, 1001).selectExpr("'S1' AS store_id", "'a' AS id", "cast(id AS int) AS d", "id * 0.5 AS x")
    tables.write_features(days, path)
    recent = tables.read_features(spark, path, min_day=900)
    assert recent.count() == 101 and recent.columns == ["id", "d", "x", "store_id"]
    scan = recent._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({P.BLOCK}" in scan and "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d,900)]" in scan
    assert len({p.name for p in Path(path).rglob(f"{P.BLOCK}=*")}) == 6


def test_rerun_replaces_only_its_runs(spark, tmp_path, rows):
    root = str(tmp_path / "runs")
    schema = "model string, fold int, id string, d int, yhat double"
    tables.write_forecasts(spark.createDataFrame([("m", 1, "a", 1, 1.0), ("m", 2, "a", 1, 2.0)], schema), root)
    tables.write_forecasts(spark.createDataFrame([("m", 2, "a", 1, 9.0), ("n", 1, "a", 1, 5.0)], schema), root)
    seen = {(r["model"], r["fold"]): r["yhat"] for r in rows(tables.read_runs(spark, root, "forecasts"))}
    assert seen == {("m", 1): 1.0, ("m", 2): 9.0, ("n", 1): 5.0}
