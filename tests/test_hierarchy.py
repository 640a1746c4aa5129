"""Levels, bottom-up, top-down and minimum trace against dense numpy algebra."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.catalog import hierarchy as C
from demandloom.operators import hierarchy as H
from demandloom.operators import mint as MT

META = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"


def _toy(spark):
    """Three items of two categories in two stores of different states, one shelf empty."""
    places = [("mug", "east"), ("mug", "west"), ("pan", "east"), ("rug", "west"), ("rug", "east")]
    rows = [(f"{i}@{s}", i, "soft" if i == "rug" else "hard", "home" if i == "rug" else "cook", s, s[0]) for i, s in places]
    return spark.createDataFrame(rows, META)


LEAVES = ("mug@east", "mug@west", "pan@east", "rug@west", "rug@east")


def _crossed(spark):
    """Ids whose order differs from the order of their keys."""
    keys = [("k9", "fig", "p"), ("k4", "yam", "q"), ("k7", "fig", "r"), ("k1", "yam", "p"), ("k5", "oat", "q"), ("k2", "oat", "p")]
    return spark.createDataFrame([(i, item, "pantry", "food", store, "gulf" if store == "r" else "hill") for i, item, store in keys], META)


def _wide(spark):
    """Uneven: eight stores in four states, five departments in two categories, one to three items each."""
    stores = [(f"{state}{k}", state) for state, n in (("dune", 1), ("fen", 4), ("moor", 1), ("reef", 2)) for k in range(n)]
    items = [(f"{dept}-{k}", dept, cat) for dept, cat, n in (("ink", "desk", 3), ("pen", "desk", 1), ("jam", "shelf", 2), ("oil", "shelf", 2), ("tea", "shelf", 1)) for k in range(n)]
    rows = [(f"{item}@{store}", item, dept, cat, store, state) for store, state in stores for item, dept, cat in items]
    return spark.createDataFrame(rows, META)


def _leaves(spark, meta, values, column="sales", day=1):
    rows = [(i, day, float(v)) for i, v in values.items()]
    return spark.createDataFrame(rows, f"id string, d int, {column} double").join(meta, "id")


def _dict(df, value="yhat"):
    return {(r.level, r.key, r.d): r[value] for r in df.collect()}


def test_level_sizes(spark):
    got = {r.level: r.n_nodes for r in H.level_sizes(_wide(spark)).collect()}
    assert got == {
        "total": 1, "state": 4, "store": 8, "category": 2, "department": 5, "state_category": 8,
        "state_department": 20, "store_category": 16, "store_department": 40, "item": 9, "item_state": 36, "item_store": 72,
    }


def test_nodes_are_numbered_by_level_and_key(spark):
    got = [(r.level, r.key, r.node_idx) for r in H.nodes(_crossed(spark)).orderBy("node_idx").collect()]
    assert [g[2] for g in got] == list(range(len(got)))
    order = {name: no for no, (name, _) in enumerate(H.LEVELS)}
    assert [g[:2] for g in got] == sorted([g[:2] for g in got], key=lambda g: (order[g[0]], g[1]))
    assert got[0][:2] == ("total", H.TOTAL_KEY) and got[-1][:2] == ("item_store", "k9")


@pytest.mark.parametrize("make", [_toy, _crossed, _wide])
def test_grouping_sets_equal_bridge_sums(spark, make):
    meta = make(spark)
    rng = np.random.default_rng(0)
    values = {r.id: int(rng.integers(0, 50)) for r in meta.collect()}
    leaves = _leaves(spark, meta, values)
    got = _dict(H.aggregate(leaves, ["sales"]), "sales")
    expected = (
        H.bridge(meta).join(leaves.select("id", "d", "sales"), "id").groupBy("level", "key", "d").agg(F.sum("sales").alias("sales"))
    )
    assert got == _dict(expected, "sales")


def test_leaf_keys_keep_their_values(spark):
    meta = _crossed(spark)
    values = {"k9": 14, "k4": 2, "k7": 21, "k1": 8, "k5": 0, "k2": 33}
    got = _dict(H.aggregate(_leaves(spark, meta, values), ["sales"]), "sales")
    assert {k: v for (level, k, _), v in got.items() if level == "item_store"} == values
    assert got[("item", "yam", 1)] == 10 and got[("store", "p", 1)] == 55 and got[("total", H.TOTAL_KEY, 1)] == 78


def _base(spark, meta, seed=0, days=(1, 2), levels=H.LEVELS):
    rng = np.random.default_rng(seed)
    nodes = H.bridge(meta, levels).select("level", "key").distinct().orderBy("level", "key").collect()
    rows = [(n.level, n.key, d, float(rng.normal(50, 10))) for n in nodes for d in days]
    return spark.createDataFrame(rows, "level string, key string, d int, yhat double")


def test_leaf_without_keys_is_refused(spark):
    base = spark.createDataFrame([("item_store", "kite@east", 1, 2.0)], "level string, key string, d int, yhat double")
    with pytest.raises(Exception, match="series without keys: kite@east"):
        H.bottom_up(base, _toy(spark)).collect()


def test_bottom_up_keeps_leaves_and_is_coherent(spark):
    meta = _crossed(spark)
    base = _base(spark, meta)
    assert H.coherence_error(base, meta).first()[0] > 1
    made = H.bottom_up(base, meta)
    assert H.coherence_error(made, meta).first()[0] < 1e-9
    known = _dict(base)
    assert all(known[k] == v for k, v in _dict(made).items() if k[0] == "item_store")


def test_top_down_spreads_the_total(spark):
    meta = _toy(spark)
    sold = dict(zip(LEAVES, (6, 0, 13, 27, 4)))
    shares = H.proportions(_leaves(spark, meta, sold))
    assert {r.id: r.share for r in shares.collect()} == pytest.approx({i: v / 50 for i, v in sold.items()})
    base = _base(spark, meta)
    made = H.top_down(base, shares, meta)
    known, got = _dict(base), _dict(made)
    for d in (1, 2):
        total = known[("total", H.TOTAL_KEY, d)]
        assert got[("total", H.TOTAL_KEY, d)] == pytest.approx(total)
        assert got[("item_store", "rug@west", d)] == pytest.approx(0.54 * total)
    assert H.coherence_error(made, meta).first()[0] < 1e-9


def test_proportions_without_sales_are_equal(spark):
    shares = H.proportions(_leaves(spark, _toy(spark), dict.fromkeys(LEAVES, 0)))
    assert {r.share for r in shares.collect()} == {0.2}


def _dense(meta, base, levels, variance, residual=None, shrink=0.0):
    """The textbook solution with explicit matrices."""
    leaves = sorted(r.id for r in meta.collect())
    known = _dict(base)
    nodes = sorted({k[:2] for k in known})
    days = sorted({k[2] for k in known})
    member = {(r.level, r.key, r.id) for r in H.bridge(meta, levels).collect()}
    S = np.array([[1.0 if (*n, leaf) in member else 0.0 for leaf in leaves] for n in nodes])
    if residual is None:
        W = np.diag([variance[n] for n in nodes])
    else:
        R = np.array([residual[n] for n in nodes])
        cov = np.cov(R)
        W = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + shrink * H.VARIANCE_FLOOR * np.eye(len(nodes))
    B = np.array([[known[(*n, d)] for d in days] for n in nodes])
    Wi = np.linalg.inv(W)
    Y = S @ np.linalg.solve(S.T @ Wi @ S, S.T @ Wi @ B)
    return {(*n, d): Y[i, j] for i, n in enumerate(nodes) for j, d in enumerate(days)}


def _weights(spark, base, seed=1):
    rng = np.random.default_rng(seed)
    nodes = sorted({(r.level, r.key) for r in base.select("level", "key").distinct().collect()})
    return spark.createDataFrame([(*n, float(rng.uniform(0.5, 20))) for n in nodes], "level string, key string, variance double")


@pytest.mark.parametrize("make", [_toy, _crossed])
def test_mint_diagonal_equals_dense_solve(spark, make):
    meta = make(spark)
    base = _base(spark, meta)
    weights = _weights(spark, base)
    variance = {(r.level, r.key): r.variance for r in weights.collect()}
    got = _dict(MT.mint(base, meta, weights))
    expected = _dense(meta, base, H.LEVELS, variance)
    assert got.keys() == expected.keys()
    for node in expected:
        assert got[node] == pytest.approx(expected[node], abs=1e-6)


def test_mint_is_optimal_and_coherent_on_upper_levels(spark):
    meta = H.shelf_meta(_wide(spark))
    base = _base(spark, meta, levels=H.UPPER_LEVELS, days=(1,))
    weights = _weights(spark, base)
    made = MT.mint(base, meta, weights, H.UPPER_LEVELS).cache()
    assert H.coherence_error(made, meta, ("d",), H.UPPER_LEVELS).first()[0] < 1e-8
    worst = MT.optimality(base, made, meta, weights, H.UPPER_LEVELS).agg(F.max(F.abs("imbalance"))).first()[0]
    assert worst < 1e-6


def test_mint_with_certain_leaves_is_bottom_up(spark):
    meta = _toy(spark)
    base = _base(spark, meta)
    sure = F.when(F.col("level") == "item_store", 1e-9).otherwise(1e3)
    weights = base.select("level", "key").distinct().withColumn("variance", sure)
    got, expected = _dict(MT.mint(base, meta, weights)), _dict(H.bottom_up(base, meta))
    for node in expected:
        assert got[node] == pytest.approx(expected[node], abs=1e-4)


def test_mint_shrink_equals_dense_solve(spark):
    """Residuals that do not add up, so the covariance term matters."""
    meta = _crossed(spark)
    base = _base(spark, meta, days=(1,))
    rng = np.random.default_rng(4)
    nodes = sorted({(r.level, r.key) for r in base.collect()})
    residual = {n: rng.normal(0, 3, 12) for n in nodes}
    rows = [(*n, t, float(v)) for n in nodes for t, v in enumerate(residual[n])]
    table = spark.createDataFrame(rows, "level string, key string, d int, resid double")
    got = _dict(MT.mint(base, meta, _weights(spark, base), shrink=0.5, residuals=table))
    expected = _dense(meta, base, H.LEVELS, None, residual, 0.5)
    for node in expected:
        assert got[node] == pytest.approx(expected[node], abs=1e-5)


@pytest.mark.parametrize("entries", [4096, 3])
def test_block_solver_equals_dense_solve(spark, monkeypatch, entries):
    """Right-hand sides of few independent columns, a null one, and matrix columns that are dealt out over salts."""
    monkeypatch.setattr(MT, "COLUMN_ENTRIES", entries)
    monkeypatch.setattr(MT, "HELPERS", 2)
    rng = np.random.default_rng(9)
    n = 60
    low = np.abs(rng.normal(size=(n, 4))) * (rng.random((n, 4)) < 0.5)
    m = low @ low.T + np.diag(rng.uniform(1, 100, n))
    m[0, 1:] = m[1:, 0] = 0.05
    b = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 7))
    b[:, 2] = 0.0
    matrix = spark.createDataFrame([(f"n{i}", f"n{j}", float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "row string, col string, m double")
    rhs = spark.createDataFrame([(f"n{i}", [float(v) for v in b[i]]) for i in range(n)], "node string, gap array<double>")
    got = {r.node: r.x for r in MT._solve(matrix, rhs, 7, 1e-11, 60).collect()}
    np.testing.assert_allclose([got[f"n{i}"] for i in range(n)], np.linalg.solve(m, b), rtol=1e-7, atol=1e-9)
    zero = rhs.withColumn("gap", F.transform("gap", lambda v: v * 0))
    assert all(not any(r.x) for r in MT._solve(matrix, zero, 7, 1e-11, 60).collect())


def _banded(spark, n):
    rows = [(f"n{i}", f"n{j}", 4.0 if i == j else 1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    return spark.createDataFrame(rows, "row string, col string, m double")


@pytest.mark.parametrize(("entries", "nodes", "wanted"), [(1 << 15, 1 << 11, 1), (30, 1 << 11, 4), (1 << 15, 8, 5)])
def test_tasks_of_a_round_follow_the_matrix(spark, monkeypatch, entries, nodes, wanted):
    """118 entries of 40 nodes, whatever number of shuffle partitions the session asks for."""
    monkeypatch.setattr(MT, "TASK_ENTRIES", entries)
    monkeypatch.setattr(MT, "TASK_NODES", nodes)
    matrix, before = _banded(spark, 40), spark.conf.get("spark.sql.shuffle.partitions")
    rhs = matrix.select(F.col("row").alias("node"), F.array(F.lit(1.0)).alias("gap")).distinct()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = MT._dealt(matrix)[0]
        assert placed.rdd.getNumPartitions() == wanted and placed.count() == 118
        placed.unpersist()
        got = MT._solve(matrix, rhs, 1, 1e-11, 60)
        assert got.rdd.getNumPartitions() <= wanted
        dense = np.diag(np.full(40, 4.0)) + np.diag(np.ones(39), 1) + np.diag(np.ones(39), -1)
        x = {r.node: r.x[0] for r in got.collect()}
        np.testing.assert_allclose([x[f"n{i}"] for i in range(40)], np.linalg.solve(dense, np.ones(40)), rtol=1e-8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_upper_tables_are_read_without_the_panel(spark, tmp_path):
    """Series, shelves, history and base are made once; only the actuals of the score still read the panel."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    shipped = [date(1995, 1, 2) + timedelta(days=C.TRAIN_END - 1 + k) for k in (-20, -9, -2, 0, 3, 11)]
    lines = [(k, k % 3, k % 2, 2.0 + k, 20.0 + k, datetime(d.year, d.month, d.day)) for k, d in enumerate(shipped)]
    made = {
        "region": spark.createDataFrame([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey long, n_regionkey long"),
        "supplier": spark.createDataFrame([(0, 0), (1, 1)], "s_suppkey long, s_nationkey long"),
        "part": spark.createDataFrame([(0, "TIN", 3), (1, "TIN", 40), (2, "ZINC", 7)], "p_partkey long, p_type string, p_size long"),
        "lineitem": spark.createDataFrame(lines, line),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for df in C._upper(spark, str(tmp_path)):
        assert not df.inputFiles() and not df.isEmpty()


def test_solver_reports_no_convergence(spark):
    meta = _crossed(spark)
    base = _base(spark, meta)
    with pytest.raises(MT.NotConverged):
        MT.mint(base, meta, _weights(spark, base), max_iter=0)


def test_constant_node_keeps_a_positive_variance(spark):
    history = spark.createDataFrame([("total", "t", d, 5) for d in range(4)], "level string, key string, d int, sales int")
    assert H.residual_variance(history).first().variance == pytest.approx(H.VARIANCE_FLOOR)


def test_shelf_leaves_meet_the_full_levels(spark):
    meta = _wide(spark)
    rng = np.random.default_rng(6)
    leaves = _leaves(spark, meta, {r.id: int(rng.integers(0, 9)) for r in meta.collect()})
    shelves = H.regroup_to_shelves(leaves, ["sales"])
    upper = _dict(H.aggregate(shelves, ["sales"], ("d",), H.UPPER_LEVELS), "sales")
    full = _dict(H.aggregate(leaves, ["sales"]), "sales")
    assert upper == {k: v for k, v in full.items() if k in upper} and len(upper) == 104


def test_flat_base_is_incoherent(spark):
    meta = _toy(spark)
    history = None
    for d in range(1, 29):
        part = _leaves(spark, meta, dict(zip(LEAVES, (3 * d, 7, 0, 11, 5))), day=d)
        history = part if history is None else history.unionByName(part)
    forecast = spark.createDataFrame([(i, 29, 2.5) for i in LEAVES], "id string, d int, yhat double")
    base = H.flat_node_base(history, forecast, 28, 1)
    got = _dict(base)
    assert got[("total", H.TOTAL_KEY, 29)] == pytest.approx(3 * 14.5 + 23) and got[("item_store", "mug@east", 29)] == 2.5
    assert H.coherence_error(base, meta).first()[0] > 0
