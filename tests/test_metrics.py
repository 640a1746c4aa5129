from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import hierarchy as H
from demandloom.operators import metrics as M
from demandloom.plans.backtest import backtest, score_levels

PRED = "id string, d int, yhat double"
TRUE = "id string, d int, sales int"
QUANTILE = "id string, d int, q double, yhat_q double"


def test_folds_are_adjacent():
    folds = M.expanding_folds(4, 11, 500)
    assert [f.train_end for f in folds] == [456, 467, 478, 489]
    assert [(f.fold_id, f.test_start, f.test_end) for f in folds] == [(1, 457, 467), (2, 468, 478), (3, 479, 489), (4, 490, 500)]


def test_folds_table_equals_the_list(spark):
    panel = spark.createDataFrame([("a", d) for d in range(1, 101)], "id string, d int")
    got = [tuple(r) for r in M.folds_table(panel, 3, 7).orderBy("fold_id").collect()]
    assert got == [(f.fold_id, f.train_end, f.test_start, f.test_end) for f in M.expanding_folds(3, 7, 100)]


def test_point_metrics(spark):
    rng = np.random.default_rng(12)
    guess, seen = rng.uniform(0, 9, 37), rng.poisson(4, 37)
    preds = spark.createDataFrame([("a", d, float(v)) for d, v in enumerate(guess)], PRED)
    truth = spark.createDataFrame([("a", d, int(v)) for d, v in enumerate(seen)], TRUE)
    row = M.point_metrics(preds, truth).first()
    miss = guess - seen
    want = (abs(miss).mean(), math.sqrt((miss**2).mean()), abs(miss).sum() / seen.sum(), miss.mean(), 37)
    assert tuple(row) == pytest.approx(want)


@pytest.mark.parametrize(
    "preds, truth, message",
    [
        ([("a", 1, 1.0), ("b", 1, 1.0)], [("a", 1, 1)], "1 predictions without an actual"),
        ([("a", 1, 1.0), ("a", 1, 2.0)], [("a", 1, 1)], "1 repeated keys"),
        ([("a", 1, 1.0)], [("a", 1, 1), ("a", 1, 2)], "1 repeated keys"),
    ],
)
def test_point_metrics_refuse_bad_matches(spark, preds, truth, message):
    with pytest.raises(Exception, match=message):
        M.point_metrics(spark.createDataFrame(preds, PRED), spark.createDataFrame(truth, TRUE)).collect()


def test_zero_actuals_give_null_wape(spark):
    row = M.point_metrics(spark.createDataFrame([("a", 1, 1.0)], PRED), spark.createDataFrame([("a", 1, 0)], TRUE)).first()
    assert row.wape is None and row.mae == 1.0


@pytest.mark.parametrize("q", [0.25, 0.835, 0.99])
def test_pinball_asymmetry(spark, q):
    """Five units too low cost q each, five too high 1 - q each."""
    df = spark.createDataFrame([(31.0, 26.0), (31.0, 36.0)], "y double, p double")
    got = [r[0] for r in df.orderBy("p").select(M.pinball(F.col("y"), F.col("p"), F.lit(q))).collect()]
    assert got == [pytest.approx(5 * q), pytest.approx(5 * (1 - q))]


def test_coverage(spark):
    seen = np.random.default_rng(13).poisson(20, 60)
    guesses = {0.3: 17.5, 0.8: 23.0}
    truth = spark.createDataFrame([("a", d, int(v)) for d, v in enumerate(seen)], TRUE)
    rows = [("a", d, q, v) for d in range(60) for q, v in guesses.items()]
    report = {r.q: r for r in M.quantile_report(spark.createDataFrame(rows, QUANTILE), truth).collect()}
    assert all(report[q].coverage == pytest.approx((seen <= v).mean()) for q, v in guesses.items())
    both = [np.mean(np.maximum(q * (seen - v), (q - 1) * (seen - v))) for q, v in guesses.items()]
    frame = spark.createDataFrame([(r.pinball,) for r in report.values()], "pinball double")
    assert M.mean_pinball(frame).first()[0] == pytest.approx(np.mean(both))


def test_quantiles_without_an_actual_are_refused(spark):
    truth = spark.createDataFrame([("a", 1, 6)], TRUE)
    made = spark.createDataFrame([("a", 1, 0.4, 5.0), ("a", 2, 0.4, 5.0)], QUANTILE)
    with pytest.raises(Exception, match="1 quantile rows without an actual"):
        M.quantile_report(made, truth).collect()


def _scale(spark, values, **options):
    rows = [("item_store", "a", d, int(v)) for d, v in enumerate(values, 1)]
    return M.naive_scale(spark.createDataFrame(rows, "level string, key string, d int, sales int"), **options).first().scale


@pytest.mark.parametrize("idle", [0, 6])
def test_naive_scale(spark, idle):
    """Days before the first sale, and the change into it, do not count."""
    sold = 1 + np.random.default_rng(14).poisson(7, 25)
    assert _scale(spark, [0] * idle + sold.tolist()) == pytest.approx((np.diff(sold) ** 2).mean())


@pytest.mark.parametrize("values", [[0] * 9, [0, 0, 8], [6] * 5])
def test_naive_scale_without_changes_is_zero(spark, values):
    assert _scale(spark, values) == 0.0


def test_naive_scale_can_skip_days(spark):
    sold = 1 + np.random.default_rng(15).poisson(5, 20)
    steps = np.delete(np.diff(sold) ** 2, [7 - 2, 16 - 2])
    skipped = spark.createDataFrame([(7,), (16,)], "d int")
    assert _scale(spark, sold, exclude_days=skipped) == pytest.approx(steps.mean())


H_KEYS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
META = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"


def _panel(spark, days=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in (1, 2):
        for s in (1, 2):
            for d in range(1, days + 1):
                rows.append((f"I{i}_S{s}", f"I{i}", "D1", "C1", f"S{s}", "ST1", d, int(rng.poisson(2 + i + s)), float(i)))
    return spark.createDataFrame(rows, META + ", d int, sales int, sell_price double")


def test_weights_sum_to_one_and_equal_per_level(spark):
    worth = {"I1_S1": 7.25, "I1_S2": 0.0, "I2_S1": 112.5, "I2_S2": 55.0}
    rows = list(worth.items())
    meta = _panel(spark, 1).select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
    weights = M.level_weights(spark.createDataFrame(rows, "id string, revenue double").join(meta, "id"))
    per_level = {r.level: r.w for r in weights.groupBy("level").agg(F.sum("weight").alias("w")).collect()}
    assert len(per_level) == 12 and all(w == pytest.approx(1 / 12) for w in per_level.values())
    leaf = weights.where("level = 'item_store' AND key = 'I2_S2'").first().weight
    assert leaf == pytest.approx(55.0 / sum(worth.values()) / 12)


def test_no_revenue_gives_no_weight(spark):
    meta = _panel(spark, 1).select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
    weights = M.level_weights(meta.withColumn("revenue", F.lit(0.0)))
    assert weights.agg(F.max("weight")).first()[0] == 0.0


def test_perfect_forecast_scores_zero_everywhere(spark):
    panel = _panel(spark)
    perfect = panel.where("d > 46").select(F.lit("m").alias("model"), "id", "d", F.col("sales").cast("double").alias("yhat"))
    scores = {r.level: r.wrmsse for r in score_levels(panel, perfect, 46, 14).collect()}
    assert set(scores) == {name for name, _ in H.LEVELS} | {"overall"}
    assert all(v == 0.0 for v in scores.values())


def test_score_equals_dense_numpy(spark):
    panel = _panel(spark, seed=3)
    T, H_ = 46, 14
    rng = np.random.default_rng(9)
    frame = panel.toPandas()
    preds = frame[frame.d > T][["id", "d"]].copy()
    preds["yhat"] = rng.uniform(1, 6, len(preds))
    forecasts = spark.createDataFrame(preds).withColumn("model", F.lit("m"))
    got = {r.level: r.wrmsse for r in score_levels(panel, forecasts, T, H_, runs=[("m",)]).collect()}

    frame = frame.merge(preds, on=["id", "d"], how="left")
    total = 0.0
    for name, keys in H.LEVELS:
        keyed = frame.assign(key=frame[list(keys)].astype(str).agg("|".join, axis=1) if keys else "t")
        score = 0.0
        recent = keyed[(keyed.d > T - 28) & (keyed.d <= T)]
        revenue = (recent.sales * recent.sell_price).groupby(recent.key).sum()
        for key, group in keyed.groupby("key"):
            daily = group.groupby("d")[["sales", "yhat"]].sum()
            past = daily.sales[daily.index <= T].to_numpy(dtype=float)
            first = np.argmax(past > 0)
            scale = np.mean(np.diff(past[first:]) ** 2)
            test = daily[daily.index > T]
            score += revenue[key] / revenue.sum() * np.sqrt(np.mean((test.yhat - test.sales) ** 2) / scale)
        assert got[name] == pytest.approx(score), name
        total += score / 12
    assert got["overall"] == pytest.approx(total)


def test_missing_forecasts_count_as_zero(spark):
    panel = _panel(spark)
    rows = panel.where("d > 46").select(F.lit("m").alias("model"), "id", "d", F.lit(3.0).alias("yhat"))
    part = rows.where("id <> 'I1_S1'")
    zero = rows.withColumn("yhat", F.when(F.col("id") == "I1_S1", 0.0).otherwise(F.col("yhat")))
    got, expected = ({r.level: r.wrmsse for r in score_levels(panel, f, 46, 14).collect()} for f in (part, zero))
    assert got == pytest.approx(expected)


def test_never_sold_node_contributes_nothing(spark):
    panel = _panel(spark).withColumn("sales", F.when(F.col("id") == "I1_S1", 0).otherwise(F.col("sales")))
    forecasts = panel.where("d > 46").select(F.lit("m").alias("model"), "id", "d", F.lit(5.0).alias("yhat"))
    assert score_levels(panel, forecasts, 46, 14).where("level = 'overall'").first().wrmsse > 0


@pytest.mark.parametrize("gap", [[46], range(10, 47)])
def test_series_without_a_row_at_the_cutoff_is_scored(spark, gap):
    """One missing row changes little, and never the set of scored series; without recent rows a series weighs nothing."""
    panel = _panel(spark)
    holed = panel.where(~((F.col("id") == "I2_S2") & F.col("d").isin(list(gap))))
    forecasts = panel.where("d > 46").select(F.lit("m").alias("model"), "id", "d", F.lit(9.0).alias("yhat"))
    revenue = M.leaf_revenue(holed, 46, keys=["id", "store_id"])
    assert revenue.where("id = 'I2_S2'").count() == (len(gap) == 1)
    weights = M.level_weights(M.leaf_revenue(holed, 46, keys=H_KEYS))
    assert weights.where("level = 'item_store'").count() == 3 + (len(gap) == 1)
    scores = {r.level: r.wrmsse for r in score_levels(holed, forecasts, 46, 14).collect()}
    assert len(scores) == 13 and all(v > 0 for v in scores.values())
    if len(gap) == 1:
        whole = {r.level: r.wrmsse for r in score_levels(panel, forecasts, 46, 14).collect()}
        assert scores["item_store"] == pytest.approx(whole["item_store"], rel=0.05)


def test_backtest_ranks_models(spark):
    panel = _panel(spark, 120)
    table = backtest(panel, M.expanding_folds(2, 14, 120), ["naive", "moving_avg_28"])
    assert table.count() == 4 and table.agg(F.min("n")).first()[0] == 4 * 14
    ranked = [r.model for r in M.mean_over_folds(table).collect()]
    assert ranked == ["moving_avg_28", "naive"]
