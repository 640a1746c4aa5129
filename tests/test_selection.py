"""Order statistics by range counting against a sort."""

from __future__ import annotations

import numpy as np
import pytest

from demandloom.functions import selection
from demandloom.operators import explore as X

RNG = np.random.default_rng(2)
TABLES = {
    "normal": RNG.normal(size=3001),
    "ties": RNG.integers(0, 4, 2500).astype(float),
    "one value": np.full(1200, 3.5),
    "outliers": np.append(RNG.normal(size=2000), [1e300, -1e300, 1e308, -1e308]),
    "close": 1 + np.arange(1500) * np.finfo(float).eps,
}


@pytest.mark.parametrize("name", TABLES)
def test_any_rank_equals_the_sorted_value(spark, name):
    values = TABLES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    ordered = np.sort(values)
    for rank in (0, 1, len(values) // 2, len(values) - 1):
        assert selection.order_statistic(df, "v", rank, buckets=8, read_rows=20) == ordered[rank]
    assert selection.median(df, "v") == np.median(values)


def test_ranks_that_do_not_exist(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert selection.median(empty, "v") is None
    with pytest.raises(ValueError, match="rank 0 of 0"):
        selection.order_statistic(empty, "v", 0)


def test_categories_come_from_the_table(spark):
    panel = spark.createDataFrame([("s", "b", 1), ("s", "b", 3), ("t", "a", 5), ("t", None, 9)], "store_id string, cat_id string, sales int")
    got = {r.store_id: (r.a, r.b) for r in X.store_category_means(panel).collect()}
    assert got == {"s": (None, 2.0), "t": (5.0, None)}
