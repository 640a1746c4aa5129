"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Every vector is scaled to unit length, rotated into ``bits`` dimensions and kept as
the signs of its coordinates, with two scalars: its length, and its inner product with
its own code. From a rotated query and a code the inner product is estimated without
bias, with an error that is bounded by the scalars. A vector is compared exactly only
if its upper bound reaches the k-th largest lower bound met so far.

Queries and vectors meet in blocks of bounded size (an equi-join on the pair of block
numbers), so no task grows with the table and nothing is broadcast. Each pair
of blocks gives at most k rows per query; their best k are found by a rank
whose limit Spark applies before the shuffle.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part; vectors of different dimension never meet; a null id takes
no part; a repeated id is one vector per row: each of its rows is a query of its own, with a list of its own under the same
query id, and a candidate for all rows but itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.tables import pick, stage

K = 20
BITS = 256
# Width of the error bound, in standard deviations of the estimate.
EPSILON = 3.0
SEED = 20
QUERY_BLOCK = 1024
# Vectors of a block: 4 MB of components.
BLOCK_BYTES = 4 << 20
_QUERY_STEP = 64


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """``max(bits, dim)`` x ``dim`` with orthonormal columns, uniformly random."""
    rows = max(bits, dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, bits: int = BITS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, inner products of unit vectors with their unit codes)."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ rotation(vectors.shape[1], bits, seed).T
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), norms, agreement


def estimate(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, agreement: np.ndarray, seed: int, bits: int, epsilon: float) -> tuple:
    """(estimated inner products, error bounds), one row per query."""
    turned = queries @ rotation(queries.shape[1], bits, seed).T
    width = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=width).astype(np.float32)
    # <q, code> with code = (2 signs - 1) / sqrt(width)
    with_code = (2 * (turned.astype(np.float32) @ signs.T) - turned.sum(axis=1, keepdims=True)) / np.sqrt(width)
    length = np.linalg.norm(queries, axis=1)[:, None]
    error = epsilon * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(max(width - 1, 1))
    # float32 sums are off by a few parts in a million of the query's length
    return with_code / agreement * norms, (error + 1e-5) * norms * length


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    total = np.zeros(len(vectors))
    for d in range(len(query)):
        total += vectors[:, d] * query[d]
    return total


def _search_block(q_rows, queries, rows, ids, vectors, codes, norms, agreement, k, bits, seed, epsilon) -> Iterator[tuple]:
    """(place of the query, neighbour ids, scores) of the best ``k`` vectors of the block, ties to smaller ids."""
    for low in range(0, len(q_rows), _QUERY_STEP):
        part = queries[low : low + _QUERY_STEP]
        estimates, errors = estimate(part, codes, norms, agreement, seed, bits, epsilon)
        lower, upper = estimates - errors, estimates + errors
        for row in range(len(part)):
            own = rows == q_rows[low + row]
            low_bounds = np.where(own, -np.inf, lower[row])
            if k < len(ids):
                bar = np.partition(low_bounds, len(ids) - k)[len(ids) - k]
                chosen = np.flatnonzero((upper[row] >= bar) & ~own)
            else:
                chosen = np.flatnonzero(~own)
            scores = exact_products(part[row], vectors[chosen])
            order = np.lexsort((ids[chosen], -scores))[:k]
            yield low + row, ids[chosen][order], scores[order]


def _encode_rows(bits: int, seed: int):
    """Adds code, norm and agreement to (row, id, dim, embedding); a batch may mix dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes, norms, agreement = encode(vectors, bits, seed)
                yield pa.record_batch(
                    {
                        "row": part.column("row"),
                        "id": part.column("id"),
                        "dim": part.column("dim"),
                        "embedding": part.column("embedding"),
                        "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                        "norm": pa.array(norms),
                        "agreement": pa.array(agreement),
                    }
                )

    return run


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, dim, embedding as doubles) of the vectors that take part."""
    source = pick(df, id=vec_id, embedding=embedding)
    source = source.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    source = source.where("id IS NOT NULL AND embedding IS NOT NULL").where(finite & some)
    return source.select("id", F.size("embedding").alias("dim"), "embedding")


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = K,
    bits: int = BITS,
    epsilon: float = EPSILON,
    seed: int = SEED,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row for which ``is_query(id)`` holds."""
    # numbered and written, so that a row keeps its number in every use
    usable = stage(usable_vectors(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()))
    id_type = usable.schema["id"].dataType.simpleString()
    # two numbers per dimension, and there are few dimensions
    counts = usable.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("q")).collect()
    plan = {r["dim"]: (-(-r["n"] // max(BLOCK_BYTES // (8 * r["dim"]), 256)), -(-r["q"] // QUERY_BLOCK)) for r in counts}
    plan = {dim: (v, q) for dim, (v, q) in plan.items() if q}
    sides = usable.sparkSession.createDataFrame(
        [(dim, v, q) for dim, (v, q) in plan.items()], "dim int, vector_blocks long, query_blocks long"
    )
    placed = usable.join(F.broadcast(sides), "dim")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))

    coded = placed.select("row", "id", "dim", "embedding").mapInArrow(
        _encode_rows(bits, seed),
        f"row long, id {id_type}, dim int, embedding array<double>, code binary, norm double, agreement double",
    )
    coded = coded.join(F.broadcast(sides), "dim")
    coded = coded.withColumn("vb", own("vector_blocks")).withColumn("qb", F.explode(numbers("query_blocks")))
    queries = placed.where(is_query(F.col("id"))).withColumn("qb", own("query_blocks"))
    queries = queries.withColumn("vb", F.explode(numbers("vector_blocks"))).select("row", "id", "dim", "embedding", "qb", "vb")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            # sorted, so that a repeated task meets the rows in the same order
            right = right.sort_values(["id", "row"])
            found = _search_block(
                left["row"].to_numpy(), np.vstack(left["embedding"].to_numpy()), right["row"].to_numpy(), right["id"].to_numpy(),
                np.vstack(right["embedding"].to_numpy()),
                np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1),
                right["norm"].to_numpy(), right["agreement"].to_numpy(), k, bits, seed, epsilon,
            )
            rows = [(np.full(len(ids), q), ids, scores) for q, ids, scores in found]
        at, ids, scores = (np.concatenate([r[i] for r in rows]) if rows else np.empty(0) for i in range(3))
        asked = left.iloc[at.astype(int)]
        return pd.DataFrame({"query_row": asked["row"].to_numpy(), "query_id": asked["id"].to_numpy(), "vec_id": ids, "score": scores})

    keys = ["dim", "qb", "vb"]
    met = queries.groupBy(*keys).cogroup(coded.groupBy(*keys))
    found = met.applyInPandas(search, f"query_row long, query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


QUERY_EVERY = 20


def nearest_query(embeddings: DataFrame) -> DataFrame:
    """The contract: queries are the rows whose vec_id is divisible by QUERY_EVERY, searched among all others."""
    return nearest(embeddings, lambda i: i % QUERY_EVERY == 0)


SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v) AS score
  FROM usable q JOIN usable v ON q.n <> v.n AND len(q.v) = len(v.v)
  WHERE q.vec_id % {QUERY_EVERY} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
