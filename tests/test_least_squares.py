"""One-pass least squares against numpy on every window by itself."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import least_squares as LS

COLUMNS = ["a", "b", "far"]
WINDOWS = {1: LS.Window(1, 40), 2: LS.Window(11, 60), 3: LS.Window(51, 90), 7: LS.Window(70, 70)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(25):
        for d in range(1, 101):
            a, b, far = rng.normal(), float(rng.integers(0, 4)), 5000 + rng.normal()
            y = None if rng.random() < 0.05 else 2 + 3 * a - b + 0.2 * (far - 5000) * (d > 45) + rng.normal()
            rows.append((f"i{i}", d, None if rng.random() < 0.1 else a, b, far, 4.0, y))
    return spark.createDataFrame(rows, "id string, d int, a double, b double, far double, flat double, sales double").cache()


def by_numpy(table, window, columns):
    rows = table.where(F.col("d").between(*window) & F.col("sales").isNotNull()).toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[columns].fillna(0.0)])
    solved = np.linalg.lstsq(x, rows.sales.to_numpy(), rcond=None)[0]
    return solved, len(rows), float(((rows.sales - x @ solved) ** 2).sum())


def test_every_window_equals_a_fit_of_its_own(table):
    fits = LS.fit_windows(table.repartition(5), COLUMNS, WINDOWS)
    assert set(fits) == set(WINDOWS)
    for key, window in WINDOWS.items():
        solved, n, residual = by_numpy(table, window, COLUMNS)
        np.testing.assert_allclose([fits[key].intercept, *fits[key].coefficients], solved, rtol=1e-6, atol=1e-7)
        assert fits[key].rows == n and fits[key].residual == pytest.approx(residual, rel=1e-7)


def test_days_are_cut_at_all_edges():
    assert LS.day_pieces(list(WINDOWS.values())) == [(1, 10), (11, 40), (41, 50), (51, 60), (61, 69), (70, 70), (71, 90)]
    assert LS.day_pieces([LS.Window(1, 3), LS.Window(8, 9)]) == [(1, 3), (8, 9)]


def test_rows_between_windows_say_nothing(table):
    windows = {1: LS.Window(1, 20), 2: LS.Window(60, 80)}
    spoilt = table.withColumn("sales", F.when(F.col("d").between(21, 59), 1e6).otherwise(F.col("sales")))
    assert LS.fit_windows(spoilt, COLUMNS, windows) == LS.fit_windows(table.where("d <= 20 OR d >= 60"), COLUMNS, windows)


def test_flat_and_repeated_columns_get_nothing(table):
    twice = table.withColumn("again", F.col("a") * 2 + F.col("b"))
    fit = LS.fit_windows(twice, ["flat", *COLUMNS, "again"], {1: LS.Window(1, 100)})[1]
    plain = LS.fit_windows(table, COLUMNS, {1: LS.Window(1, 100)})[1]
    # a is null, and so counts as 0, in some rows where "again" is null as well
    assert fit.coefficients[0] == 0
    assert fit.residual <= plain.residual + 1e-6
    exact = table.fillna({"a": 0.0}).withColumn("again", F.col("a") * 2 + F.col("b"))
    assert LS.fit_windows(exact, [*COLUMNS, "again"], {1: LS.Window(1, 100)})[1].coefficients[3] == 0


def test_predictions_of_all_folds(table):
    fits = LS.fit_windows(table, COLUMNS, {1: LS.Window(1, 40), 2: LS.Window(11, 60)})
    ahead = {1: LS.Window(41, 50), 2: LS.Window(45, 52)}
    got = {(r.fold, r.id, r.d): r.yhat for r in LS.predict_windows(table, COLUMNS, fits, ahead).collect()}
    rows = table.where(F.col("d").between(41, 52)).fillna({"a": 0.0}).collect()
    expected = {}
    for r in rows:
        for fold, window in ahead.items():
            if window.first <= r.d <= window.last:
                value = fits[fold].intercept + sum(c * r[name] for c, name in zip(fits[fold].coefficients, COLUMNS))
                expected[fold, r.id, r.d] = max(value, 0.0)
    assert got == pytest.approx(expected) and len(got) == 25 * 18


def test_a_window_without_rows_is_an_error(table):
    with pytest.raises(ValueError, match="days 200 to 210"):
        LS.fit_windows(table, COLUMNS, {1: LS.Window(1, 20), 2: LS.Window(200, 210)})


def test_all_windows_take_one_pass(spark, table):
    """As many rows leave the scan for three folds as for the union of their days."""
    pieces = LS.day_pieces(list(WINDOWS.values()))
    plan = LS.moment_sums(table, COLUMNS, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Union" not in plan
    assert LS.moment_sums(table, COLUMNS, pieces).count() == len(pieces) * 15
