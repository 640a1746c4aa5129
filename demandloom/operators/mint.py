"""Minimum-trace reconciliation at any number of nodes.

With C the matrix that takes every upper node less the sum of its leaves, the
reconciled leaves are  b - W C' (C W C')^-1 C b.  The system has one unknown per
upper node and day and is positive definite, so conjugate gradients solve it
with joins and grouped sums; no matrix leaves the executors.

Every node is one row whose arrays hold all days. The matrix is partitioned once, the columns of nodes that share leaves
with very many others dealt out by a salt. The days search together (block conjugate gradients): the directions of a
round serve all of them, and directions that others already span are dropped, so a few rounds do. A round is one join,
one sum per node, and one reduction, which fetches matrices of days by days.

For the shrinkage covariance W is a diagonal plus f R R' of rank T, the number of residual days. The diagonal
system is solved once for the days of the horizon and for the T columns C R together; a T x T system on the driver
joins the two solutions. So no round knows of the residuals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.hierarchy import (
    LEVELS,
    VARIANCE_FLOOR,
    Level,
    _nodes_of_leaf,
    aggregate,
    bridge,
    leaf_level,
    with_keys,
)
from demandloom.session import cut_lineage

# Rounds between two checkpoints of the solver's state, and entries of a matrix column that one task takes.
CHECKPOINT_ROUNDS = 3
COLUMN_ENTRIES = 4096
# Entries and nodes that one task of a round takes: the matrix, not the session, says how many tasks there are.
TASK_ENTRIES, TASK_NODES = 1 << 15, 1 << 11
# Random right-hand sides that are solved along: their directions spare the days rounds.
HELPERS = 24
# A direction of which the others leave less than this share (of its square) is dropped.
SPAN_TOL = 1e-13


class NotConverged(RuntimeError):
    """The solver used up its iterations."""


def _node() -> Column:
    return F.concat_ws(":", "level", "key").alias("node")


def _overlap_matrix(meta: DataFrame, weights: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """(row, col, m): the entries of C W C' for diagonal W.

    m sums the variances of the leaves that two nodes share, plus the node's
    own variance on the diagonal. A leaf emits one entry per pair of levels, a
    fixed number, and partial sums fold the entries of the large nodes.
    """
    leaf = leaf_level(levels)
    leaf_weights = weights.where(F.col("level") == leaf).select(F.col("key").alias("id"), "variance")
    upper = F.filter(_nodes_of_leaf(levels), lambda n: n["level"] != leaf)
    names = F.transform(upper, lambda n: F.concat_ws(":", n["level"], n["key"]))
    shared = (
        meta.join(leaf_weights, "id")
        .select(names.alias("_names"), "variance")
        .select("_names", "variance", F.explode("_names").alias("row"))
        .select("row", F.explode("_names").alias("col"), F.col("variance").alias("m"))
    )
    own = weights.where(F.col("level") != leaf).select(_node().alias("row"), _node().alias("col"), F.col("variance").alias("m"))
    return shared.unionByName(own).groupBy("row", "col").agg(F.sum("m").alias("m"))


def _gap(values: DataFrame, meta: DataFrame, value: str, day: str, levels: Sequence[Level]) -> DataFrame:
    """(node, day, gap): every upper node's value less the sum of its leaves."""
    leaf = leaf_level(levels)
    leaves = values.where(F.col("level") == leaf).select(F.col("key").alias("id"), day, F.col(value).alias("_sum"))
    implied = aggregate(with_keys(leaves, meta), ["_sum"], (day,), levels)
    both = values.where(F.col("level") != leaf).join(implied, ["level", "key", day])
    return both.select(_node(), day, (F.col(value) - F.col("_sum")).alias("gap"))


def _arrays(long: DataFrame, keys: Sequence[str], day: str, days: Sequence[int], value: str) -> DataFrame:
    """(*keys, value) with one array over ``days`` per key; what is absent counts as 0. A group has one row per day."""
    by_day = F.map_from_entries(F.collect_list(F.struct(F.col(day).cast("int"), F.col(value).cast("double"))))
    wanted = F.array(*[F.lit(int(d)) for d in days])
    grouped = long.groupBy(*keys).agg(by_day.alias("_by_day"))
    filled = F.transform(wanted, lambda d: F.coalesce(F.try_element_at("_by_day", d), F.lit(0.0)))
    return grouped.select(*keys, filled.alias(value))


def _days(df: DataFrame, day: str) -> list[int]:
    """The days of a horizon or of the residuals: as many numbers as a node has values."""
    return sorted(r[0] for r in df.select(day).distinct().collect())


def _per_entry(size: int, value) -> Column:
    """An array of ``value(i)`` for i = 0 .. size - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value)


def _sum_arrays(column: str, weight: str | None = None) -> Column:
    weighted = (F.col(weight),) if weight else ()
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column)), *weighted))


def _dealt(matrix: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(matrix with salt, (node, diag, fan), tasks of a round): a column of many entries is dealt out over ``fan`` salts.

    The tasks follow the matrix and not the session, so a small matrix lies in one partition.
    """
    fan = F.ceil(F.col("entries") / COLUMN_ENTRIES).cast("int")
    diagonal = F.max(F.when(F.col("row") == F.col("col"), F.col("m")))
    counted = matrix.groupBy("col").agg(F.count("*").alias("entries"), diagonal.alias("diag"))
    columns = cut_lineage(counted.withColumn("fan", fan))
    salted = matrix.join(columns.select("col", "fan"), "col").withColumn("salt", F.pmod(F.hash("row"), F.col("fan")))
    entries, n_nodes = columns.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.count("*")).first()
    tasks = max(1, math.ceil(entries / TASK_ENTRIES), math.ceil(n_nodes / TASK_NODES))
    placed = salted.select("row", "col", "salt", "m").repartition(tasks, "col", "salt").persist(StorageLevel.MEMORY_AND_DISK)
    return placed, columns.select(F.col("col").alias("node"), "diag", "fan"), tasks


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def _square(parts: DataFrame, blocks: int, size: int) -> list[np.ndarray]:
    """The sum of flat matrices, one row per partition, as ``blocks`` matrices of equal size."""
    total = parts.agg(_sum_arrays("flat").alias("sums")).first()["sums"]
    return list(np.array(total).reshape(blocks, -1, size))


def _rest_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """r'r / diag over a partition."""
    total = 0
    for batch in batches:
        if len(batch):
            r = _stacked(batch.column("r"))
            total = total + r.T @ (r / batch.column("diag").to_numpy()[:, None])
    if np.ndim(total):
        yield pa.record_batch({"flat": _lists(total.reshape(1, -1))})


def _round_products(size: int):
    """p'q, p'r, q'r / diag, q'q / diag and r'r / diag over a partition, each padded to ``size`` columns and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                p, q, r = (_stacked(batch.column(c)) for c in "pqr")
                diag, blocks = batch.column("diag").to_numpy()[:, None], np.zeros((5, size, size))
                for block, value in zip(blocks, (p.T @ q, p.T @ r, q.T @ (r / diag), q.T @ (q / diag), r.T @ (r / diag))):
                    block[: value.shape[0], : value.shape[1]] = value
                total = blocks if total is None else total + blocks
        if total is not None:
            yield pa.record_batch({"flat": _lists(total.reshape(1, -1))})

    return run


def _advance(alpha: np.ndarray, beta: np.ndarray, turn: np.ndarray):
    """One step of all nodes: solution x, rest r, and the next directions p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p, q, x, r = (_stacked(batch.column(c)) for c in "pqxr")
                x, r = x + p @ alpha, r - q @ alpha
                p = (r / batch.column("diag").to_numpy()[:, None] + p @ beta) @ turn
                kept = {c: batch.column(c) for c in ("node", "diag", "fan")}
                yield pa.record_batch(kept | {"p": _lists(p), "x": _lists(x), "r": _lists(r)})

    return run


def _directions(gram: np.ndarray, rest: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """How the days' candidate directions, with inner products ``gram``, combine to orthonormal ones; settled days give none."""
    scale = np.where(rest > goal, 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300)), 0.0)
    values, axes = np.linalg.eigh(gram * np.outer(scale, scale))
    solid = values > SPAN_TOL * max(values.max(), 1e-300)
    return scale[:, None] * axes[:, solid] / np.sqrt(values[solid])


def _solve(matrix: DataFrame, rhs: DataFrame, size: int, tol: float, max_iter: int) -> DataFrame:
    """(node, x) with matrix x = rhs for each of the ``size`` entries of the arrays. Entries of the matrix are not negative.

    Block conjugate gradients preconditioned by the diagonal, with orthonormal directions in the diagonal's metric. Rounds
    are held in memory and on disk, and every CHECKPOINT_ROUNDS rounds the state is checkpointed.
    """
    placed, nodes, tasks = _dealt(matrix)
    wanted, size = size, size + HELPERS
    zero, none = F.array_repeat(F.lit(0.0), size), F.array().cast("array<double>")
    helper = F.transform(F.sequence(F.lit(1), F.lit(HELPERS)), lambda i: F.xxhash64("node", i) / float(1 << 63) * F.sqrt("diag"))
    start = nodes.join(rhs, "node").select(
        "node", "diag", "fan", none.alias("p"), zero.alias("x"), F.concat("gap", helper).alias("r")
    )
    start = cut_lineage(start)
    rest = _square(start.select("diag", "r").mapInArrow(_rest_products, "flat array<double>"), 1, size)[0]
    goal = np.where(np.arange(size) < wanted, np.diag(rest) * tol * tol, 0.0)
    solution = F.slice("x", 1, wanted).alias("x")
    if not goal.any():
        placed.unpersist()
        return start.select("node", solution)
    nothing, old = np.zeros((0, size)), None
    first = start.withColumn("q", F.col("p"))
    state = first.mapInArrow(_advance(nothing, nothing, _directions(rest, np.diag(rest), goal)), start.schema)
    try:
        for done in range(max_iter):
            # a node's own arrays travel along its diagonal entry, so that a round reads the one before it once
            salts = F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt")
            own = F.struct("diag", "fan", "p", "x", "r")
            sent = state.select(F.col("node").alias("col"), "p", own.alias("own"), salts)
            met = placed.join(sent, ["col", "salt"])
            met = met.select(F.col("row").alias("node"), "m", "p", F.when(F.col("row") == F.col("col"), F.col("own")).alias("own"))
            product = met.groupBy("node").agg(_sum_arrays("p", "m").alias("q"), F.first("own", True).alias("own"))
            here = product.select("node", "q", "own.*").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
            parts = here.select("p", "q", "r", "diag").mapInArrow(_round_products(size), "flat array<double>")
            pq, pr, qr, qq, rr = _square(parts, 5, size)
            if old is not None:
                old.unpersist()
            old, inverse = here, np.linalg.pinv((pq + pq.T) / 2, hermitian=True)
            alpha = inverse @ pr
            after = rr - qr.T @ alpha - alpha.T @ qr + alpha.T @ qq @ alpha
            beta = -inverse @ (qr - qq @ alpha)
            k = int(np.count_nonzero(np.diag(pq)))
            turn = _directions(after + beta.T @ beta, np.diag(after), goal)
            state = here.mapInArrow(_advance(alpha[:k], beta[:k], turn), start.schema)
            if (np.diag(after) <= goal)[:wanted].all():
                return cut_lineage(state.select("node", solution))
            if (done + 1) % CHECKPOINT_ROUNDS == 0:
                state = cut_lineage(state)
    finally:
        placed.unpersist()
        if old is not None:
            old.unpersist()
    raise NotConverged(f"no convergence to {tol} in {max_iter} iterations")


def _centred(residuals: DataFrame) -> DataFrame:
    means = residuals.groupBy("level", "key").agg(F.avg("resid").alias("_mean"))
    return residuals.join(means, ["level", "key"]).select(
        "level", "key", F.col("d").alias("t"), (F.col("resid") - F.col("_mean")).alias("resid")
    )


def _inner_products(pairs: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over rows of the outer products of two array columns; one matrix per partition is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = _stacked(batch.column(0)).T @ _stacked(batch.column(1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"t": pa.array(np.arange(len(total), dtype=np.int32)), "values": _lists(total)})

    parts = pairs.select(left, right).mapInArrow(run, "t int, values array<double>")
    rows = parts.groupBy("t").agg(_sum_arrays("values").alias("values")).orderBy("t").collect()
    return np.array([r["values"] for r in rows])


def _times(df: DataFrame, key: str, column: str, matrix: np.ndarray, name: str) -> DataFrame:
    """(key, name): the array ``column`` times ``matrix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.record_batch({key: batch.column(0), name: _lists(_stacked(batch.column(1)) @ matrix)})

    return df.select(key, column).mapInArrow(run, f"{key} string, {name} array<double>")


def mint(
    base: DataFrame,
    meta: DataFrame,
    weights: DataFrame,
    levels: Sequence[Level] = LEVELS,
    shrink: float = 0.0,
    residuals: DataFrame | None = None,
    tol: float = 1e-10,
    max_iter: int = 500,
) -> DataFrame:
    """Coherent (level, key, d, yhat) nearest to ``base`` in the metric of the error variances.

    ``weights`` (level, key, variance) is the diagonal W. With ``residuals``
    (level, key, d, resid) and ``shrink`` > 0, W is instead
    (1 - shrink) cov + shrink diag(cov); the covariance is never formed, only
    its products with the residual table. The driver holds matrices of residual days by days.
    """
    leaf, is_leaf = leaf_level(levels), F.col("level") == leaf_level(levels)
    # read several times each, and small beside what they are made from
    base, meta = cut_lineage(base.select("level", "key", "d", "yhat")), cut_lineage(meta)
    days = _days(base, "d")
    gaps = _arrays(_gap(base, meta, "yhat", "d", levels), ["node"], "d", days, "gap")
    resid, times = None, []
    if residuals is not None and shrink > 0:
        resid = cut_lineage(_centred(residuals))
        times = _days(resid, "t")
        weights = resid.groupBy("level", "key").agg(
            ((F.sum(F.col("resid") * F.col("resid")) / (len(times) - 1) + VARIANCE_FLOOR) * shrink).alias("variance")
        )
        known = cut_lineage(_arrays(_gap(resid, meta, "resid", "t", levels), ["node"], "t", times, "gap").withColumnRenamed("gap", "known"))
        gaps = known.join(gaps, "node").select("node", F.concat("known", "gap").alias("gap"))
    weights = cut_lineage(weights)
    matrix = cut_lineage(_overlap_matrix(meta, weights, levels))
    solution = _solve(matrix, gaps, len(times) + len(days), tol, max_iter)

    reached = None
    if resid is not None:
        factor = (1.0 - shrink) / (len(times) - 1)
        # with y solving for the residual columns K and z for the gaps: x = z - y (I / f + K'y)^-1 K'z
        products = _inner_products(known.join(solution, "node"), "known", "x")
        inside, beside = products[:, : len(times)], products[:, len(times) :]
        small = np.linalg.solve(np.eye(len(times)) / factor + inside, beside) if factor else np.zeros(beside.shape)
        reached = (beside - inside @ small) * factor
        solution = _times(solution, "node", "x", np.vstack([-small, np.eye(len(days))]), "x")

    member = bridge(meta, levels).where(F.col("level") != leaf).select(_node(), "id")
    pulled = member.join(solution, "node").groupBy("id").agg(_sum_arrays("x").alias("pull"))
    leaf_weights = weights.where(is_leaf).select(F.col("key").alias("id"), "variance")
    own = _arrays(base.where(is_leaf).withColumnRenamed("key", "id"), ["id"], "d", days, "yhat")
    leaves = own.join(pulled, "id").join(leaf_weights, "id")
    moved = _per_entry(len(days), lambda i: F.get("yhat", i) + F.col("variance") * F.get("pull", i))
    leaves = leaves.select("id", moved.alias("yhat"))
    if reached is not None:
        of_leaf = _arrays(resid.where(is_leaf).withColumnRenamed("key", "id"), ["id"], "t", times, "resid")
        leaves = leaves.join(_times(of_leaf, "id", "resid", reached, "shift"), "id")
        leaves = leaves.select("id", _per_entry(len(days), lambda i: F.get("yhat", i) - F.get("shift", i)).alias("yhat"))
    rows = leaves.select("id", F.posexplode("yhat").alias("_at", "yhat"))
    of_day = F.get(F.array(*[F.lit(int(d)) for d in days]), F.col("_at"))
    return aggregate(with_keys(rows.select("id", of_day.alias("d"), "yhat"), meta), ["yhat"], ("d",), levels)


def optimality(base: DataFrame, reconciled: DataFrame, meta: DataFrame, weights: DataFrame, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """(key, d, imbalance) per leaf: the weighted changes summed over the leaf's nodes.

    All zero exactly at the minimum-trace solution with diagonal weights.
    """
    changed = (
        base.join(reconciled.withColumnRenamed("yhat", "_new"), ["level", "key", "d"])
        .join(weights, ["level", "key"])
        .select("level", "key", "d", ((F.col("yhat") - F.col("_new")) / F.col("variance")).alias("_push"))
    )
    spread = bridge(meta, levels).join(changed, ["level", "key"])
    return spread.groupBy(F.col("id").alias("key"), "d").agg(F.sum("_push").alias("imbalance"))
