from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.functions.ordering import dense_index, running_total
from demandloom.operators import training_windows as TW

DAYS, END, CONTEXT = 230, 195, 63
LEVELS = (4, 35, 0.9, 12, 6)
FIRST = dt.date(2014, 10, 6)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i, level in enumerate(LEVELS):
        for d in range(1, DAYS + 1):
            day = FIRST + dt.timedelta(days=d - 1)
            rows.append(
                (f"s{i}", f"item{4 - i}", f"dept{i % 3}", "st1", d, int(rng.poisson(level)), day.weekday(), day.day, day.month, 0, 0, 1.5 + i)
            )
    schema = (
        "id string, item_id string, dept_id string, store_id string, d int, sales int, dow int, dom int, month int, "
        "snap int, is_event int, sell_price double"
    )
    return spark.createDataFrame(rows, schema).cache()


def test_arrays_are_in_day_order(panel):
    row = TW.series_arrays(panel.orderBy(F.rand(1))).where("id = 's0'").first()
    expected = [r.sales for r in panel.where("id = 's0'").orderBy("d").collect()]
    assert row.sales == [float(v) for v in expected] and row.first_day == 1
    assert row.covs[0] == pytest.approx([FIRST.weekday() / 7, FIRST.day / 31, FIRST.month / 12, 0, 0, np.log(1 + 1.5)])


def test_codes_are_dense_and_sorted(panel):
    meta = panel.select("id", "item_id", "dept_id", "store_id").distinct()
    got = {r.id: r[1:] for r in TW.dense_codes(meta).collect()}
    assert got == {f"s{i}": (4 - i, i % 3, 0) for i in range(5)}


def test_windows_end_before_the_cutoff(panel):
    blank = TW.blank_after(panel, END)
    draws = TW.sample_windows(TW.series_weights(panel, END), 200, END, CONTEXT)
    assert draws.count() == 200
    low, high = draws.agg(F.min("start"), F.max("start")).first()
    assert low >= CONTEXT and high + TW.HORIZON < END
    cut = TW.cut_windows(TW.series_arrays(blank), draws, CONTEXT)
    sizes = cut.select(F.size("past"), F.size("target"), F.size("past_covs"), F.size("future_covs")).distinct().collect()
    assert [tuple(s) for s in sizes] == [(CONTEXT, TW.HORIZON, CONTEXT, TW.HORIZON)]


def test_window_holds_the_right_days(panel):
    arrays = TW.series_arrays(panel)
    row = TW.cut_windows(arrays, arrays.where("id = 's2'").select("id", F.lit(131).alias("start")), CONTEXT).first()
    values = [r.sales for r in panel.where("id = 's2'").orderBy("d").collect()]
    assert row.past == values[131 - CONTEXT : 131] and row.target == values[131:159]
    assert row.nu == pytest.approx(1 + np.mean(row.past))
    np.testing.assert_allclose(row.past_scaled, np.array(row.past) / row.nu)


def test_inference_window_starts_after_the_cutoff(panel):
    made = TW.inference_windows(TW.series_arrays(TW.blank_after(panel, END)), END, CONTEXT)
    assert made.count() == len(LEVELS)
    assert made.select(F.sum(F.aggregate("target", F.lit(0.0), lambda a, x: a + x))).first()[0] == 0


def test_draws_follow_the_weights_and_repeat(panel):
    weights = TW.series_weights(panel, END)
    first = TW.sample_windows(weights, 4000, END, CONTEXT)
    share = {r.id: r["count"] / 4000 for r in first.groupBy("id").count().collect()}
    whole = weights.agg(F.sum("weight")).first()[0]
    for row in weights.collect():
        assert share.get(row.id, 0) == pytest.approx(row.weight / whole, abs=0.03)
    assert first.exceptAll(TW.sample_windows(weights, 4000, END, CONTEXT)).isEmpty()
    assert not first.exceptAll(TW.sample_windows(weights, 4000, END, CONTEXT, seed=7)).isEmpty()


def test_uniform_numbers_are_bits_of_md5(spark):
    got = spark.range(500).select("id", TW.uniform(7, F.col("id")).alias("u")).collect()
    for r in got:
        assert r.u == int(hashlib.md5(f"7:{r.id}".encode()).hexdigest()[:13], 16) / 2**52
    assert 0.45 < np.mean([r.u for r in got]) < 0.55


def test_running_total_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("lpad(cast((id * 7919) % 1000 as string), 4, '0') AS k", "(id * 7919) % 1000 AS v")
    got = running_total(df, ["k"], F.col("v"), "total").orderBy("k").collect()
    assert [r.total for r in got] == list(np.cumsum(range(1000)))
    assert [r.i for r in dense_index(df, ["k"], "i").orderBy("k").collect()] == list(range(1000))
