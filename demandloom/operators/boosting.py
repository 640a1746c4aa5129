"""Boosted trees on a loss of choice by distributed histograms.

Columns are cut into bins once, by quantiles from one pass. Every level of a tree is one pass over the binned
rows: tasks add up the loss's first and second derivatives per (node, feature, bin), Spark sums those histograms,
and windows over them find each node's best split. The driver gets one row per node.

Tasks recompute the scores of the rows from the trees so far; every ``KEPT_ROUNDS`` rounds the scores are written, which
bounds that work. Rows and columns are subsampled by hashes of their number and the round, so reruns agree.

A missing value has a bin of its own below all others. Categories are split as sets: in the order of their
mean derivative, which holds the best of all sets for a convex loss; values unseen in a node go right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.forecast import not_negative
from demandloom.session import scratch_path

BINS = 64
KEPT_ROUNDS = 10
MAX_CATEGORIES = 10_000
# Derivatives are rounded to this step, so that their sums do not depend on the order of tasks.
_STEP = 2.0**-20
# Histogram rows of node LOSSES hold the summed loss of training (feature 0) and stopping rows (feature 1).
LOSSES = -1


class Tweedie(NamedTuple):
    """Deviance of a compound Poisson-gamma variable with a log link; 1 < power < 2."""

    power: float = 1.1

    def start(self, mean: float) -> float:
        return float(np.log(max(mean, 1e-9)))

    def derivatives(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.exp((1 - self.power) * score), np.exp((2 - self.power) * score)
        return high - y * low, (2 - self.power) * high - (1 - self.power) * y * low

    def loss(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.exp((2 - self.power) * score) / (2 - self.power) - y * np.exp((1 - self.power) * score) / (1 - self.power)

    def mean(self, score: np.ndarray) -> np.ndarray:
        return np.exp(score)


class Squared(NamedTuple):
    """Half the squared error with an identity link."""

    def start(self, mean: float) -> float:
        return float(mean)

    def derivatives(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return score - y, np.ones_like(score)

    def loss(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (score - y) ** 2 / 2

    def mean(self, score: np.ndarray) -> np.ndarray:
        return score


@dataclass
class Tree:
    """Nodes by number; ``left[i]`` is -1 for a leaf. ``lower[i]`` marks the bins that go left."""

    feature: list[int] = field(default_factory=list)
    lower: list[np.ndarray] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, width: int) -> int:
        self.feature.append(0)
        self.lower.append(np.zeros(width, bool))
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        self.gain.append(0.0)
        return len(self.value) - 1

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of every row."""
        feature, lower = np.array(self.feature), np.array(self.lower)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(depth):
            down = np.where(lower[node, bins[rows, feature[node]]], left[node], right[node])
            node = np.where(left[node] < 0, node, down)
        return node


class Bins(NamedTuple):
    """How columns become bin numbers: 0 is missing; numbers by cut points, categories by code."""

    columns: tuple[str, ...]
    categories: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    codes: tuple[dict[str, int], ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.columns + self.categories

    @property
    def width(self) -> int:
        return max([len(c) + 2 for c in self.cuts] + [len(c) + 1 for c in self.codes])

    def select(self) -> list[Column]:
        numbers = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)]
        return numbers + [F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(self.categories)]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(batch), len(self.names)), np.uint16)
        for i, cuts in enumerate(self.cuts):
            x = batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float)
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="left") + 1)
        for i, codes in enumerate(self.codes):
            found = batch.column(f"_c{i}").dictionary_encode()
            known = np.array([codes.get(v, 0) for v in found.dictionary.to_pylist()] + [0])
            out[:, len(self.cuts) + i] = known[found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)]
        return out


def find_bins(rows: DataFrame, columns: Sequence[str], categories: Sequence[str] = (), bins: int = BINS) -> Bins:
    """Cut points at quantiles of the columns, codes of the categories' values. One pass each."""
    steps = [i / bins for i in range(1, bins)]
    clean = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns]
    found = rows.agg(*[F.percentile_approx(c, steps, 10_000).alias(f"_{i}") for i, c in enumerate(clean)]).first() if columns else ()
    cuts = tuple(np.unique(np.array(f or [], float)) for f in found)
    codes = []
    for name in categories:
        values = [r[0] for r in rows.select(F.col(f"`{name}`").cast("string")).distinct().dropna().limit(MAX_CATEGORIES + 1).collect()]
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"{name} has over {MAX_CATEGORIES} values; use a numeric encoding of it")
        codes.append({v: i + 1 for i, v in enumerate(sorted(values))})
    return Bins(tuple(columns), tuple(categories), cuts, tuple(codes))


def _binned(rows: DataFrame, bins: Bins, target: str, valid: Column, key: Sequence[str]) -> DataFrame:
    """(key, y, valid, score, bins) of every row with a target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = bins.of(batch)
            packed = [row.tobytes() for row in made]
            yield pa.record_batch(
                {
                    "key": batch.column("key"), "y": batch.column("y"), "valid": batch.column("valid"),
                    "score": pa.array(np.zeros(len(batch))), "bins": pa.array(packed, pa.binary()),
                }
            )

    named = [F.xxhash64(*key).alias("key"), F.col(target).cast("double").alias("y"), F.coalesce(valid, F.lit(False)).alias("valid")]
    chosen = rows.where(F.col(target).isNotNull()).select(*named, *bins.select())
    return chosen.mapInArrow(run, "key long, y double, valid boolean, score double, bins binary")


def _matrix(column: pa.BinaryArray, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, features)


def _taken(keys: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows of the round's sample: a hash of key and round below the share."""
    x = keys.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53) < share


class Boosting:
    """One run: the binned table and the trees so far."""

    def __init__(self, rows, columns, categories, target, valid, key, loss, bins, depth, step, l2, min_rows, row_share, feature_share, seed):
        self.loss, self.depth, self.step, self.l2, self.min_rows = loss, depth, step, l2, min_rows
        self.row_share, self.feature_share, self.seed = row_share, feature_share, seed
        trained = rows.where(~F.coalesce(valid, F.lit(False)) & F.col(target).isNotNull())
        self.bins = find_bins(trained, columns, categories, bins)
        mean = trained.agg(F.avg(target)).first()[0]
        if mean is None:
            raise ValueError("no training rows")
        self.start = loss.start(mean)
        self.trees: list[Tree] = []
        self.fresh: list[Tree] = []
        self.table = self._keep(_binned(rows, self.bins, target, valid, key).withColumn("score", F.lit(self.start)))

    def _keep(self, table: DataFrame) -> DataFrame:
        """Written to the shared folder, and held in memory as far as that goes: a lost part is read again."""
        path = scratch_path(table.sparkSession, "boosting")
        table.write.parquet(path)
        return table.sparkSession.read.parquet(path).persist(StorageLevel.MEMORY_AND_DISK)

    def _scored(self, batch: pa.RecordBatch, fresh: Sequence[Tree]) -> tuple[np.ndarray, np.ndarray]:
        bins = _matrix(batch.column("bins"), len(self.bins.names))
        score = batch.column("score").to_numpy().copy()
        for tree in fresh:
            score += np.array(tree.value)[tree.place(bins, self.depth)]
        return bins, score

    def _without_table(self) -> Boosting:
        """What tasks need of this."""
        other = object.__new__(Boosting)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("table", "trees")}
        return other

    def write_scores(self) -> None:
        job = self._without_table()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, score = job._scored(batch, job.fresh)
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

        before, self.table = self.table, self._keep(self.table.mapInArrow(run, self.table.schema))
        before.unpersist()
        self.fresh = []

    def histograms(self, tree: Tree, level_nodes: Sequence[int], chosen: np.ndarray, number: int) -> DataFrame:
        """(node, feature, bin, g, h, n) of the nodes of one level, and the losses before the round; summed per task only."""
        job, width, features = self._without_table(), self.bins.width, len(self.bins.names)
        slot = np.full(len(tree.value), -1)
        slot[list(level_nodes)] = np.arange(len(level_nodes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, len(level_nodes) * features * width))
            losses = np.zeros((2, 2))
            for batch in batches:
                bins, score = job._scored(batch, job.fresh)
                y = batch.column("y").to_numpy()
                valid = batch.column("valid").to_numpy(zero_copy_only=False).astype(bool)
                loss = job.loss.loss(y, score)
                for i, part in enumerate((~valid, valid)):
                    losses[:, i] += loss[part].sum(), part.sum()
                at = slot[tree.place(bins, job.depth)]
                keys = batch.column("key").to_numpy()
                rows = np.flatnonzero(~valid & (at >= 0) & _taken(keys, number, job.row_share))
                g, h = (np.rint(v / _STEP) * _STEP for v in job.loss.derivatives(y[rows], score[rows]))
                place = ((at[rows, None] * features + chosen) * width + bins[rows][:, chosen]).ravel()
                for total, weights in zip(sums, (np.repeat(g, len(chosen)), np.repeat(h, len(chosen)), None)):
                    total += np.bincount(place, weights, minlength=total.size)
            some = np.flatnonzero(sums[2])
            node, rest = np.divmod(some, features * width)
            loss_rows = np.flatnonzero(losses[1])
            g, h, n = (np.append(s[some], extra) for s, extra in zip(sums, (losses[0][loss_rows], losses[1][loss_rows], losses[1][loss_rows])))
            yield pa.record_batch(
                {
                    "node": pa.array(np.append(np.array(level_nodes)[node], np.full(len(loss_rows), LOSSES)).astype(np.int32)),
                    "feature": pa.array(np.append(rest // width, loss_rows).astype(np.int32)),
                    "bin": pa.array(np.append(rest % width, np.zeros(len(loss_rows))).astype(np.int32)),
                    "g": pa.array(g), "h": pa.array(h), "n": pa.array(n.astype(np.int64)),
                }
            )

        return self.table.mapInArrow(run, "node int, feature int, bin int, g double, h double, n long")

    def best_splits(self, parts: DataFrame) -> DataFrame:
        """(node, g, h, n, best): the sums of every node and its best split, null where none is allowed."""
        # each task has summed its rows, so the sums are moved once, to where a feature's bins meet
        summed = parts.repartition("node", "feature").groupBy("node", "feature", "bin")
        summed = summed.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        is_set = F.col("feature") >= len(self.bins.columns)
        rank = F.when(is_set, F.coalesce(F.col("g") / F.nullif(F.col("h") + self.l2, F.lit(0.0)), F.lit(0.0))).otherwise(F.col("bin").cast("double"))
        of_feature = Window.partitionBy("node", "feature")
        run = of_feature.orderBy("rank", "bin").rowsBetween(Window.unboundedPreceding, 0)
        table = summed.withColumn("rank", rank)
        for c in "ghn":
            table = table.withColumns({f"{c}_left": F.sum(c).over(run), f"{c}_all": F.sum(c).over(of_feature)})
        table = table.withColumn("set", F.when(is_set, F.collect_list("bin").over(run)))
        score = lambda g, h: g * g / F.nullif(h + self.l2, F.lit(0.0))
        g, h, n = (F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ghn")
        gain = score(F.col("g_left"), F.col("h_left")) + score(g, h) - score(F.col("g_all"), F.col("h_all"))
        table = table.withColumn("gain", gain)
        allowed = (F.col("n_left") >= self.min_rows) & (n >= self.min_rows) & (F.col("gain") > 0)
        split = F.struct("gain", (-F.col("feature")).alias("minus_feature"), (-F.col("bin")).alias("minus_bin"), "g_left", "h_left", "set")
        totals = [F.max(f"{c}_all").alias(c) for c in "ghn"]
        return table.groupBy("node").agg(*totals, F.max(F.when(allowed & (F.col("node") != LOSSES), split)).alias("best"))

    def losses(self) -> tuple[float, float | None]:
        """Mean loss of training and of stopping rows with the trees so far."""
        stub = Tree()
        stub.add(0.0, self.bins.width)
        parts = self.histograms(stub, [], np.zeros(0, int), 0).groupBy("feature").agg(F.sum("g"), F.sum("n"))
        return _mean_losses({r[0]: (r[1], r[2]) for r in parts.collect()})

    def grow(self, number: int) -> tuple[Tree, tuple[float, float | None]]:
        """The next tree, and the losses before it."""
        width, features = self.bins.width, len(self.bins.names)
        count = max(1, round(self.feature_share * features))
        chosen = np.sort(np.random.default_rng([self.seed, number]).permutation(features)[:count])
        tree, losses = Tree(), (float("nan"), None)
        level = [tree.add(0.0, width)]
        for depth in range(self.depth):
            parts = self.histograms(tree, level, chosen, number)
            if depth == 0:
                parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
                kept = parts.where(F.col("node") == LOSSES).groupBy("feature").agg(F.sum("g"), F.sum("n"))
                found = self.best_splits(parts.where(F.col("node") != LOSSES)).collect()
                losses = _mean_losses({r[0]: (r[1], r[2]) for r in kept.collect()})
                parts.unpersist()
            else:
                found = self.best_splits(parts.where(F.col("node") != LOSSES)).collect()
            level = []
            for r in sorted(found, key=lambda r: r["node"]):
                node, best = r["node"], r["best"]
                if depth == 0:
                    tree.value[node] = self._leaf(r["g"], r["h"])
                if best is None:
                    continue
                tree.feature[node], tree.gain[node] = -best["minus_feature"], best["gain"]
                if best["set"] is None:
                    tree.lower[node][: -best["minus_bin"] + 1] = True
                else:
                    tree.lower[node][best["set"]] = True
                tree.left[node] = tree.add(self._leaf(best["g_left"], best["h_left"]), width)
                tree.right[node] = tree.add(self._leaf(r["g"] - best["g_left"], r["h"] - best["h_left"]), width)
                level += [tree.left[node], tree.right[node]]
            if not level:
                break
        return tree, losses

    def _leaf(self, g: float, h: float) -> float:
        return -self.step * g / (h + self.l2) if h + self.l2 > 0 else 0.0


def _mean_losses(sums: dict[int, tuple[float, int]]) -> tuple[float, float | None]:
    means = {i: total / n for i, (total, n) in sums.items() if n}
    return means.get(0, float("nan")), means.get(1)


@dataclass
class Ensemble:
    """``history`` holds the mean (training, stopping) loss before the first tree and after each one."""

    bins: Bins
    start: float
    trees: list[Tree]
    loss: Tweedie | Squared
    depth: int
    history: list[tuple[float, float | None]]

    def predict(self, features: DataFrame, future: DataFrame) -> DataFrame:
        """(id, d, yhat >= 0) for the rows of ``future``; absent features count as missing."""
        rows = future.select("id", "d").join(features, ["id", "d"], "left").select("id", "d", *self.bins.select())
        bins, start, trees, loss, depth = self.bins, self.start, self.trees, self.loss, self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = bins.of(batch)
                score = np.full(len(batch), start)
                for tree in trees:
                    score += np.array(tree.value)[tree.place(made, depth)]
                yield pa.record_batch({"id": batch.column("id"), "d": batch.column("d"), "yhat": pa.array(loss.mean(score))})

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        made = rows.mapInArrow(run, f"id {kinds['id']}, d {kinds['d']}, yhat double")
        return made.select("id", "d", not_negative(F.col("yhat")).alias("yhat"))

    def nodes(self, spark) -> DataFrame:
        """(tree, node, feature, gain, value): the ensemble as a table; feature and gain are null for leaves."""
        rows = [
            (t, i, self.bins.names[tree.feature[i]] if tree.left[i] >= 0 else None,
             float(tree.gain[i]) if tree.left[i] >= 0 else None, float(tree.value[i]))
            for t, tree in enumerate(self.trees) for i in range(len(tree.value))
        ]
        return spark.createDataFrame(rows, "tree int, node int, feature string, gain double, value double")

    def importance(self, spark) -> DataFrame:
        """(feature, gain, splits) of all inputs, largest gain first."""
        names = spark.createDataFrame([(n,) for n in self.bins.names], "feature string")
        return count_splits(self.nodes(spark), names)


def count_splits(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(feature, gain, splits) of every name, from the inner nodes of an ensemble."""
    used = nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
    table = names.join(used, "feature", "left").fillna({"gain": 0.0, "splits": 0})
    return table.select("feature", "gain", "splits").orderBy(F.desc("gain"), "feature")


def boost(
    rows: DataFrame,
    columns: Sequence[str],
    categories: Sequence[str] = (),
    target: str = "sales",
    valid: Column | None = None,
    key: Sequence[str] = ("id", "d"),
    loss: Tweedie | Squared = Tweedie(),
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.05,
    bins: int = BINS,
    l2: float = 1.0,
    min_rows: int = 20,
    row_share: float = 0.8,
    feature_share: float = 0.8,
    patience: int = 20,
    seed: int = 42,
) -> Ensemble:
    """Trees fitted one after another to the derivatives of ``loss``.

    Rows where ``valid`` holds are not trained on: once their loss has not fallen for ``patience`` rounds, the trees
    up to its least are kept. ``key`` names a row for sampling.
    """
    valid = F.lit(False) if valid is None else valid
    run = Boosting(rows, columns, categories, target, valid, key, loss, bins, depth, step, l2, min_rows, row_share, feature_share, seed)
    history: list[tuple[float, float | None]] = []
    try:
        for number in range(rounds):
            tree, before = run.grow(number)
            history.append(before)
            stop = [v for _, v in history if v is not None]
            if stop and len(stop) - 1 - int(np.argmin(stop)) >= patience:
                break
            run.trees.append(tree)
            run.fresh.append(tree)
            if len(run.fresh) == KEPT_ROUNDS:
                run.write_scores()
        else:
            history.append(run.losses())
    finally:
        run.table.unpersist()
    stop = [v for _, v in history if v is not None]
    best = int(np.argmin(stop)) if stop else len(run.trees)
    return Ensemble(run.bins, run.start, run.trees[:best], loss, depth, history)
