"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred table X.

Every step is one pass of Spark over the rows: p = X v less its part along the earlier left vectors, and X'p in the same
pass. A left vector is as long as the table, so it is not stored: it is kept as the d numbers m with u = X m, and rows
recompute what they need of it. A lost executor therefore loses no state. Both sides are reorthogonalised against
all earlier vectors: the left ones with inner products from the pass, the right ones on the driver. The driver holds
a few vectors of the embeddings' dimension per step and nothing that grows with the rows; its small singular value
decomposition gives components and deviations.

One start vector finds one vector of a repeated singular value. When the wanted ones have settled before the dimensions
are used up, the search starts again at right angles to them, until it finds nothing larger.

Rows are packed once into blocks of numbers, so that passes read integers and no nested rows.

Entries are counted in 1024ths with ``OFFSET`` added, so sums and deviations are exact whole numbers.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and all others are fitted and returned,
a null or repeated id as a row of its own; a vector shorter than the longest counts as continued with zeros; entries
beyond 2**52 in size count as 2**52; a deviation beyond the range of a long is null; directions without
variance are no components, so a table with fewer has fewer rows per vector, and one row or none gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import pick, stage

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
SEED = 11
# Rows of a packed block times their dimension.
BLOCK_NUMBERS = 1 << 18
_MOST = float(1 << 52)
_LOW_BITS = 26
_LONG = float(1 << 63)
_EPS = np.finfo(float).eps
# Up to so many dimensions the bidiagonalisation runs to its end; beyond, it stops once what is wanted has settled.
SHORT_RUN = 128


class Fit(NamedTuple):
    """Rows, per-dimension sums, components as columns, their eigenvalues, the trace, and the error of whitening."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def _as_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as whole numbers, shorter ones continued with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(column), dim))
    rows[np.arange(dim) < lengths[:, None]] = values
    with np.errstate(over="ignore"):
        return (np.clip(np.floor(SCALE * rows), -_MOST, _MOST) + OFFSET).astype(np.int64)


def _pack(dim: int):
    """Blocks of rows: (ids, x as little-endian longs)."""
    size = max(1, BLOCK_NUMBERS // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = pa.list_(batch.schema.field("id").type)
            for first in range(0, len(batch), size):
                part = batch.slice(first, size)
                x = _as_rows(part.column("embedding"), dim).astype("<i8").tobytes()
                yield pa.record_batch(
                    {"ids": pa.array([part.column("id").to_pylist()], id_type), "x": pa.array([x], pa.binary())}
                )

    return run


def _numbers(block: pa.BinaryScalar, dim: int) -> np.ndarray:
    return np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dim)


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, embedding as doubles) of the vectors without null or non-finite entries."""
    source = pick(df, id=vec_id, embedding=embedding).withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return source.where(F.col("embedding").isNotNull() & finite)


class Packed:
    """The rows in blocks, with passes that return sums over all of them."""

    def __init__(self, df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding"):
        spark, rows = df.sparkSession, usable(df, vec_id, embedding)
        self.id_type = rows.schema["id"].dataType.simpleString()
        self.dim = rows.agg(F.greatest(F.max(F.size("embedding")), F.lit(1))).first()[0]
        self.table = stage(rows.mapInArrow(_pack(self.dim), f"ids array<{self.id_type}>, x binary"))
        # 8 MB of numbers to a task at least, and a task for every core
        tasks = self.table.agg(F.ceil(F.coalesce(F.sum(F.octet_length("x")), F.lit(0)) / (8 << 20))).first()[0]
        self.passes = self.table.select("x").coalesce(max(int(tasks), spark.sparkContext.defaultParallelism))
        self.passes = self.passes.persist(StorageLevel.MEMORY_AND_DISK)
        low = self._sum_longs(lambda x: np.concatenate([[len(x)], (x >> _LOW_BITS).sum(axis=0), (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)]))
        self.n, high, rest = low[0], low[1 : 1 + self.dim], low[1 + self.dim :]
        self.sums = [(h << _LOW_BITS) + r for h, r in zip(high, rest)]

    def _sums(self, of_block, kind: str, numpy_type) -> list:
        """The sum over all blocks of the numbers that ``of_block`` makes of one; added up by position before they are fetched."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for block in (b for batch in batches for b in batch.column("x")):
                part = of_block(_numbers(block, dim))
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch({"at": pa.array(np.arange(len(total), dtype=np.int32)), "value": pa.array(total.astype(numpy_type))})

        parts = self.passes.mapInArrow(run, f"at int, value {kind}")
        kept = "decimal(38,0)" if kind == "long" else kind
        return [r["total"] for r in parts.groupBy("at").agg(F.sum(F.col("value").cast(kept)).alias("total")).orderBy("at").collect()]

    def _sum_longs(self, of_block) -> list[int]:
        found = [int(v) for v in self._sums(of_block, "long", np.int64)]
        return found or [0] * (1 + 2 * self.dim)

    def sum_doubles(self, of_centred) -> np.ndarray:
        """The sum over all blocks of what ``of_centred`` makes of a block's centred rows."""
        n, sums = self.n, self.sums
        return np.array(self._sums(lambda x: of_centred(centred(x, n, sums)), "double", float))

    def close(self) -> None:
        self.passes.unpersist()


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | None:
    """n x - S, exact, or None where a long cannot hold it."""
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0) >= 1 << 62:
        return None
    return x * n - np.array(sums, np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    exact = _scaled(x, n, sums)
    return x - np.array([s / n for s in sums]) if exact is None else exact / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n x - S) ** 2, exact; None beyond the range of a long."""
    exact = _scaled(x, n, sums)
    if exact is None:
        whole = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        return [v if v < 1 << 63 else None for v in whole]
    rough = (exact.astype(float) ** 2).sum(axis=1)
    if rough.max(initial=0) < 0.99 * _LONG:
        return (exact * exact).sum(axis=1).tolist()
    whole = [sum(int(c) ** 2 for c in row) for row in exact]
    return [v if v < 1 << 63 else None for v in whole]


def _at_right_angles(q: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for basis in bases:
            q = q - basis @ (basis.T @ q)
    return q


def bidiagonalise(step, dim: int, locked: np.ndarray, wanted: int, scale: float, rng, short_run: int = SHORT_RUN) -> tuple:
    """(singular values, right vectors as columns, whether all dimensions were used) of X at right angles to ``locked``.

    ``step(t, m)`` is the pass: for p = X t it returns p'p, (X m)'p and X'p. ``scale`` is the norm of X.
    """
    right, left, images = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    # X right = U band, with U = X left
    band, beta, settled = np.zeros((0, 0)), 0.0, False
    tiny = scale * _EPS * dim
    q = rng.standard_normal(dim)
    while right.shape[1] + locked.shape[1] < dim and not settled:
        if beta <= tiny:  # the space so far is closed: go on in what is left
            q, beta = rng.standard_normal(dim), 0.0
        q = _at_right_angles(q, locked, right)
        v = q / np.linalg.norm(q)
        column = np.zeros(left.shape[1])
        column[-1:] = beta
        squares, along, image = step(v - left @ column, left)
        image = image - images @ along
        alpha = np.sqrt(max(squares - along @ along, 0.0))
        column = column + along
        band = np.column_stack([band, column])
        right = np.column_stack([right, v])
        if alpha <= tiny:  # X v adds no left vector
            beta = 0.0
            continue
        band = np.vstack([band, np.append(np.zeros(right.shape[1] - 1), alpha)])
        left = np.column_stack([left, (v - left @ column) / alpha])
        images = np.column_stack([images, image / alpha])
        q = _at_right_angles(image / alpha - alpha * v, locked, right)
        beta = float(np.linalg.norm(q))
        if dim > short_run and left.shape[1] >= wanted:
            ends = np.abs(np.linalg.svd(band, full_matrices=False)[0][-1, :wanted]) * beta
            settled = bool((ends <= 4 * _EPS * scale).all())
    _, values, turned = np.linalg.svd(band, full_matrices=False)
    return values, right @ turned.T, right.shape[1] + locked.shape[1] >= dim


def leading(step, dim: int, wanted: int, scale: float, seed: int = SEED, short_run: int = SHORT_RUN) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest singular values and their right vectors, repeated values included."""
    rng = np.random.default_rng(seed)
    values, vectors, whole = bidiagonalise(step, dim, np.zeros((dim, 0)), wanted, scale, rng, short_run)
    values, vectors = values[:wanted], vectors[:, :wanted]
    while not whole:
        more, others, whole = bidiagonalise(step, dim, vectors, 1, scale, rng, short_run)
        if not len(more) or (len(values) >= wanted and more[0] <= values[wanted - 1] * (1 + 1e-12)):
            break
        values, vectors = np.append(values, more[0]), np.column_stack([vectors, others[:, :1]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        whole = False
    values, vectors = values[:wanted], vectors[:, :wanted]
    solid = values > scale * _EPS * dim * 8
    return values[solid], vectors[:, solid]


def fit(packed: Packed, components: int = COMPONENTS, seed: int = SEED, short_run: int = SHORT_RUN) -> Fit | None:
    """Components and deviations of the packed rows; None when no direction varies."""
    dim, n = packed.dim, packed.n
    total = float(packed.sum_doubles(lambda c: np.array([(c * c).sum()]))[0]) if n > 1 else 0.0
    if total <= 0:
        return None

    def step(t: np.ndarray, m: np.ndarray) -> tuple:
        def sums(c: np.ndarray) -> np.ndarray:
            p = c @ t
            return np.concatenate([[p @ p], (c @ m).T @ p, c.T @ p])

        found = packed.sum_doubles(sums)
        k = m.shape[1]
        return found[0], found[1 : 1 + k], found[1 + k :]

    values, vectors = leading(step, dim, components, np.sqrt(total), seed, short_run)
    # either sign is right: the largest entry of a component is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    turn = vectors * (np.sqrt(n) / values)
    k = len(values)
    covariance = packed.sum_doubles(lambda c: ((c @ turn).T @ (c @ turn)).ravel()).reshape(k, k) / n
    return Fit(n, packed.sums, vectors, values**2 / n, total / n, float(np.abs(covariance - np.eye(k)).max()))


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    packed = Packed(df, vec_id, embedding)
    found = fit(packed, components)
    packed.close()
    schema = (
        f"id {packed.id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, dim, k = found.n, found.sums, packed.dim, len(found.values)
    turn, share = found.vectors / np.sqrt(found.values), found.values / found.trace
    error = found.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in (b for batch in batches for b in zip(batch.column("ids"), batch.column("x"))):
            x = _numbers(block, dim)
            rows = len(x)
            yield pa.record_batch(
                {
                    "id": ids.values.take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, n)),
                    "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    "whitened": pa.array((centred(x, n, sums) @ turn).ravel()),
                    "explained": pa.array(np.tile(share, rows)),
                    "identity_error": pa.array(np.full(rows * k, error)),
                }
            )

    return packed.table.mapInArrow(run, schema)


def whitened_query(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(embeddings).withColumnRenamed("id", "vec_id")
