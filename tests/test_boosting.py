"""Distributed boosted trees against a slow version that tries every split by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.operators import boosting as B
from demandloom.sources import tables

COLUMNS, CATEGORIES = ["a", "b"], ["kind"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        a, b, kind = float(rng.integers(0, 9)), float(rng.normal()), str(rng.choice(list("pqrstu")))
        level = 1 + a / 4 + (2.5 if kind in "qst" else 0) + (b > 0.5)
        rows.append((f"i{i}", 1 + i % 60, None if i % 11 == 0 else a, b, None if i % 37 == 5 else kind, float(rng.poisson(level))))
    rows.append(("no target", 1, 1.0, 1.0, "p", None))
    return spark.createDataFrame(rows, "id string, d int, a double, b double, kind string, sales double").repartition(3).cache()


def by_hand(bins, y, start, loss, rounds, depth, step, l2, min_rows, n_numbers):
    """Scores after every round, trying all splits of all nodes."""
    score, out = np.full(len(y), start), []
    for _ in range(rounds):
        g, h = loss.derivatives(y, score)
        score = score.copy()

        def grow(rows, level):
            best = (0.0, None)
            G, H = g[rows].sum(), h[rows].sum()
            for f in range(bins.shape[1]) if level else ():
                present = sorted(set(bins[rows, f]))
                if f >= n_numbers:
                    present.sort(key=lambda v: g[rows][bins[rows, f] == v].sum() / (h[rows][bins[rows, f] == v].sum() + l2))
                for cut in range(1, len(present)):
                    left = np.isin(bins[rows, f], present[:cut])
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                    if min(left.sum(), (~left).sum()) >= min_rows and gain > best[0] + 1e-9:
                        best = (gain, left)
            if best[1] is None:
                score[rows] += -step * G / (H + l2)
            else:
                grow(rows[best[1]], level - 1)
                grow(rows[~best[1]], level - 1)

        grow(np.arange(len(y)), depth)
        out.append(score)
    return out


@pytest.mark.parametrize("loss", [B.Tweedie(1.1), B.Tweedie(1.7), B.Squared()])
def test_scores_equal_trees_grown_by_hand(table, loss):
    options = {"rounds": 4, "depth": 3, "step": 0.3, "l2": 0.7, "min_rows": 9}
    made = B.boost(table, COLUMNS, CATEGORIES, loss=loss, row_share=1.0, feature_share=1.0, bins=16, **options)
    rows = table.where("sales IS NOT NULL").toPandas()
    codes = rows.kind.map(made.bins.codes[0]).fillna(0).astype(int)
    numbers = [np.where(rows[c].isna(), 0, 1 + (rows[c].to_numpy()[:, None] > cuts).sum(axis=1)) for c, cuts in zip(COLUMNS, made.bins.cuts)]
    y = rows.sales.to_numpy()
    scores = by_hand(np.column_stack([*numbers, codes]), y, loss.start(y.mean()), loss, n_numbers=2, **options)
    got = made.predict(table, table.where("sales IS NOT NULL")).toPandas().set_index("id").yhat[rows.id]
    np.testing.assert_allclose(got, np.maximum(loss.mean(scores[-1]), 0), rtol=1e-5)
    losses = [loss.loss(y, np.full(len(y), made.start)).mean(), *[loss.loss(y, s).mean() for s in scores]]
    np.testing.assert_allclose([h[0] for h in made.history], losses, rtol=1e-5)


def test_loss_falls_every_round_with_samples_too(table):
    made = B.boost(table, COLUMNS, CATEGORIES, rounds=12, depth=3, step=0.1, min_rows=5)
    falls = np.diff([h[0] for h in made.history])
    assert len(made.trees) == 12 and len(falls) == 12 and (falls < 0).all()  # written scores included: 12 > KEPT_ROUNDS


def test_stops_where_the_stopping_rows_turn(table):
    noise = table.withColumn("sales", (F.xxhash64("id") % 5 + 5).cast("double")).withColumn("late", F.col("d") > 40)
    made = B.boost(noise, ["b"], ["kind"], valid=F.col("late"), rounds=30, depth=4, step=0.5, min_rows=1, patience=3, l2=0.0, loss=B.Squared())
    stop = [v for _, v in made.history]
    assert len(made.trees) == int(np.argmin(stop)) < 30 and len(stop) <= len(made.trees) + 1 + 3


def test_splits_are_counted_and_stored(spark, table, tmp_path):
    made = B.boost(table, COLUMNS, CATEGORIES, rounds=3, depth=3, min_rows=10)
    nodes, found = made.nodes(spark), made.importance(spark).collect()
    inner = nodes.where("feature IS NOT NULL").count()
    assert sum(r.splits for r in found) == inner == sum(len(t.value) - 1 for t in made.trees) // 2 > 0
    assert {r.feature for r in found} == {*COLUMNS, *CATEGORIES}
    assert [r.gain for r in found] == sorted((r.gain for r in found), reverse=True)
    for fold in (1, 2):
        stored = made.importance(spark).select(F.lit("trees").alias("model"), F.lit(fold).alias("fold"), "feature", "gain", "splits")
        tables.write_importances(stored, str(tmp_path))
    read = tables.read_runs(spark, str(tmp_path), "importances", "trees", 2).collect()
    assert {(r.feature, r.gain, r.splits) for r in read} == {(r.feature, r.gain, r.splits) for r in found}


def test_reruns_agree_whatever_the_partitions(table):
    first, again = (B.boost(t, COLUMNS, CATEGORIES, rounds=3, depth=3, min_rows=5).trees for t in (table, table.repartition(7)))
    assert [(t.value, t.feature, t.left) for t in first] == [(t.value, t.feature, t.left) for t in again]


def test_unseen_and_missing_inputs_are_predicted(spark, table):
    made = B.boost(table, COLUMNS, CATEGORIES, rounds=2, depth=3, min_rows=5)
    odd = spark.createDataFrame([("x", 1, None, None, None), ("y", 1, float("nan"), 1e300, "new")], "id string, d int, a double, b double, kind string")
    asked = spark.createDataFrame([("x", 1), ("y", 1), ("absent", 4)], "id string, d int")
    got = made.predict(odd, asked).collect()
    assert len(got) == 3 and all(r.yhat > 0 for r in got)


def test_what_cannot_be_fitted_is_refused(table, monkeypatch):
    with pytest.raises(ValueError, match="no training rows"):
        B.boost(table.where("sales IS NULL"), COLUMNS)
    monkeypatch.setattr(B, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError, match="kind has over 3"):
        B.boost(table, COLUMNS, CATEGORIES)
