"""Ordinary least squares of many training windows from one pass over the rows.

What a fit needs of its rows are sums: X'X, X'y and y'y with a column of ones. Sums of disjoint rows add up, so the
days are cut at all window edges, the sums are formed once per piece, and a window's sums are those of its pieces.
Overlapping folds then cost one scan, whatever their number; the solver sees a matrix of the columns' size only.

A column that does not vary in a window, or that the columns before it explain, gets the coefficient 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.forecast import not_negative
from demandloom.operators.panel import day_slice

# Least variance of a column against its squared mean, and least share of it that earlier columns leave unexplained.
LEAST_VARIANCE = 1e-10
LEAST_PIVOT = 1e-8


class Window(NamedTuple):
    """The days first..last, both included."""

    first: int
    last: int


class LinearFit(NamedTuple):
    """``rows`` is the number of training rows; ``residual`` the sum of squared residuals."""

    intercept: float
    coefficients: tuple[float, ...]
    rows: int
    residual: float


def as_numbers(columns: Sequence[str]) -> list[Column]:
    """The columns as doubles under their own names, null as 0."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in columns]


def day_pieces(windows: Sequence[Window]) -> list[Window]:
    """The days of all windows cut at every window's edges, in order; days in no window are left out."""
    edges = sorted({w.first for w in windows} | {w.last + 1 for w in windows})
    pieces = [Window(a, b - 1) for a, b in zip(edges, edges[1:])]
    return [p for p in pieces if any(w.first <= p.first and p.last <= w.last for w in windows)]


def _piece_sums(columns: Sequence[str], target: str, pieces: Sequence[Window]):
    """Adds up Z'Z per piece over a partition, for Z = (1, columns, target); the upper triangle leaves, row by row."""
    firsts = np.array([p.first for p in pieces])
    size = len(columns) + 2
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pieces), size, size))
        seen = np.zeros(len(pieces), bool)
        for batch in batches:
            z = np.column_stack(
                [np.ones(len(batch)), *[batch.column(c).to_numpy(zero_copy_only=False) for c in (*columns, target)]]
            )
            piece = np.searchsorted(firsts, batch.column("d").to_numpy(zero_copy_only=False), side="right") - 1
            for p in np.unique(piece):
                part = z[piece == p]
                sums[p] += part.T @ part
                seen[p] = True
        for p in np.flatnonzero(seen):
            yield pa.record_batch(
                {
                    "piece": pa.array(np.full(len(upper[0]), p, np.int32)),
                    "at": pa.array(np.arange(len(upper[0]), dtype=np.int32)),
                    "value": pa.array(sums[p][upper]),
                }
            )

    return run


def moment_sums(rows: DataFrame, columns: Sequence[str], pieces: Sequence[Window], target: str = "sales") -> DataFrame:
    """(piece, at, value): the sums of every piece, ``at`` counting the upper triangle of Z'Z row by row.

    Rows without a target say nothing. A partition sends one triangle per piece it holds, however many rows it has.
    """
    inside = F.lit(False)
    for piece in pieces:
        inside = inside | F.col("d").between(piece.first, piece.last)
    kept = rows.where(inside & F.col(target).isNotNull())
    numbers = kept.select(F.col("d").cast("int").alias("d"), *as_numbers([*columns, target]))
    parts = numbers.mapInArrow(_piece_sums(columns, target, pieces), "piece int, at int, value double")
    return parts.groupBy("piece", "at").agg(F.sum("value").alias("value"))


def solve(moments: np.ndarray) -> LinearFit:
    """The least-squares line through rows with the sums ``moments`` = Z'Z.

    Columns are swept in their order on the scale of correlations.
    """
    n = moments[0, 0]
    mean = moments[0] / n
    spread = moments - n * np.outer(mean, mean)
    variance = np.diag(spread)[1:-1]
    varies = variance / n > LEAST_VARIANCE * mean[1:-1] ** 2
    scale = np.sqrt(np.where(varies, variance, 1.0))
    cross = spread[1:-1, 1:] / scale[:, None]
    cross[:, :-1] /= scale
    for k in range(len(cross)):
        pivot = cross[k, k]
        if not varies[k] or pivot <= LEAST_PIVOT:
            cross[k] = 0.0
            continue
        row = cross[k] / pivot
        cross -= np.outer(cross[:, k], row)
        cross[k] = row
    slopes = cross[:, -1] / scale
    residual = spread[-1, -1] - slopes @ spread[1:-1, -1]
    return LinearFit(float(mean[-1] - slopes @ mean[1:-1]), tuple(map(float, slopes)), int(round(n)), float(max(residual, 0.0)))


def fit_windows(
    rows: DataFrame, columns: Sequence[str], windows: Mapping[int, Window], target: str = "sales"
) -> dict[int, LinearFit]:
    """A fit per window, from one scan of ``rows``. The driver gets one triangle per piece, whose number the windows bound."""
    pieces = day_pieces(list(windows.values()))
    size = len(columns) + 2
    sums = np.zeros((len(pieces), size * (size + 1) // 2))
    for r in moment_sums(rows, columns, pieces, target).collect():
        sums[r["piece"], r["at"]] = r["value"]
    fits = {}
    for key, window in windows.items():
        total = sum(s for s, p in zip(sums, pieces) if window.first <= p.first and p.last <= window.last)
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = total
        if full[0, 0] == 0:
            raise ValueError(f"no training rows on days {window.first} to {window.last}")
        fits[key] = solve(full + np.triu(full, 1).T)
    return fits


def predict_windows(
    features: DataFrame, columns: Sequence[str], fits: Mapping[int, LinearFit], ahead: Mapping[int, Window]
) -> DataFrame:
    """(fold, id, d, yhat >= 0): every fit on the rows of its days ``ahead``, in one pass over ``features``."""
    folds = F.array(
        *[
            F.struct(
                F.lit(key).alias("fold"), F.lit(ahead[key].first).alias("first"), F.lit(ahead[key].last).alias("last"),
                F.lit(fit.intercept).alias("intercept"), F.array(*map(F.lit, fit.coefficients)).alias("slopes"),
            )
            for key, fit in fits.items()
        ]
    )
    rows = day_slice(features, min(w.first for w in ahead.values()), max(w.last for w in ahead.values()))
    rows = rows.select("id", "d", *as_numbers(columns))
    hit = rows.withColumn("_fit", F.explode(F.filter(folds, lambda f: F.col("d").between(f["first"], f["last"]))))
    value = F.col("_fit.intercept")
    for i, c in enumerate(columns):
        value = value + F.col(f"`{c}`") * F.col("_fit.slopes")[i]
    return hit.select(F.col("_fit.fold").alias("fold"), "id", "d", not_negative(value).alias("yhat"))
