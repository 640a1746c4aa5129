"""Aggregation levels, their nodes, and coherent forecasts.

Values live in long tables (level, key, d, ...). There is no summing matrix:
grouping sets aggregate, and a bridge table (node, leaf) serves projections.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.ordering import dense_index
from demandloom.operators.panel import day_slice

Level = tuple[str, tuple[str, ...]]

# The twelve levels from the total down to the leaf, which is last.
LEVELS: tuple[Level, ...] = (
    ("total", ()),
    ("state", ("state_id",)),
    ("store", ("store_id",)),
    ("category", ("cat_id",)),
    ("department", ("dept_id",)),
    ("state_category", ("state_id", "cat_id")),
    ("state_department", ("state_id", "dept_id")),
    ("store_category", ("store_id", "cat_id")),
    ("store_department", ("store_id", "dept_id")),
    ("item", ("item_id",)),
    ("item_state", ("item_id", "state_id")),
    ("item_store", ("item_id", "store_id")),
)
UPPER_LEVELS = LEVELS[:9]
TOTAL_KEY = "__total__"
KEY_SEPARATOR = "|"


def leaf_level(levels: Sequence[Level]) -> str:
    return levels[-1][0]


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws(KEY_SEPARATOR, *columns) if columns else F.lit(TOTAL_KEY)


def _nodes_of_leaf(levels: Sequence[Level]) -> Column:
    """An array with the (level_no, level, key) of every node a leaf belongs to."""
    last = len(levels) - 1
    return F.array(
        *[
            F.struct(
                F.lit(no).alias("level_no"),
                F.lit(name).alias("level"),
                (F.col("id") if no == last else _key(columns)).alias("key"),
            )
            for no, (name, columns) in enumerate(levels)
        ]
    )


def bridge(meta: DataFrame, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """(level_no, level, key, id): which leaves make up which node."""
    return meta.select(F.inline(_nodes_of_leaf(levels)), "id")


def nodes(meta: DataFrame, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """(level, key, node_idx): levels in order, keys sorted within a level."""
    distinct = bridge(meta, levels).select("level_no", "level", "key").distinct()
    return dense_index(distinct, ["level_no", "key"], "node_idx").select("level", "key", "node_idx")


def level_sizes(meta: DataFrame, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """(level, n_nodes)."""
    return bridge(meta, levels).groupBy("level").agg(F.countDistinct("key").alias("n_nodes"))


def _sum_sets(rows: DataFrame, levels: Sequence[Level], values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per node of ``levels``, from rows that carry all their key columns."""
    columns = list(dict.fromkeys(c for _, keys in levels for c in keys))
    sets = [[*by, *keys] for _, keys in levels]
    grouped = rows.groupingSets(sets, *by, *columns).agg(
        F.grouping_id().alias("_gid"), *[F.sum(v).alias(v) for v in values]
    )
    level, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, keys in levels:
        # grouping_id has a 1 bit for every key column that is summed away
        gid = int("".join("0" if c in keys else "1" for c in columns) or "0", 2)
        level = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(level)
        key = F.when(F.col("_gid") == gid, _key(keys)).otherwise(key)
    return grouped.select(level.alias("level"), key.alias("key"), *by, *values)


def aggregate(
    leaves: DataFrame, values: Sequence[str], by: Sequence[str] = ("d",), levels: Sequence[Level] = LEVELS
) -> DataFrame:
    """Sum leaf values to every node: (level, key, *by, *values).

    ``leaves`` has one row per (id, *by) with the key columns. Levels are split
    into those with and without the item. Each part is first summed to its own
    finest keys and only that small table goes through the grouping sets, so
    leaf rows are never multiplied by the number of levels.
    """
    *upper, (leaf_name, _) = levels
    with_item = [lv for lv in upper if "item_id" in lv[1]]
    without = [lv for lv in upper if "item_id" not in lv[1]]
    parts = [leaves.select(F.lit(leaf_name).alias("level"), F.col("id").alias("key"), *by, *values)]
    for part in (without, with_item):
        if part:
            finest = list(dict.fromkeys(c for _, keys in part for c in keys))
            folded = leaves.groupBy(*by, *finest).agg(*[F.sum(v).alias(v) for v in values])
            parts.append(_sum_sets(folded, part, values, by))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_keys(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach the key columns of the series to rows keyed by id; a series unknown to ``meta`` fails the job."""
    found = rows.join(meta.withColumn("_known", F.lit(True)), "id", "left")
    refused = F.raise_error(F.concat(F.lit("series without keys: "), F.coalesce("id", F.lit("null")))).cast("boolean")
    return found.where(F.coalesce("_known", refused)).drop("_known")


def bottom_up(
    base: DataFrame, meta: DataFrame, by: Sequence[str] = ("d",), levels: Sequence[Level] = LEVELS
) -> DataFrame:
    """Keep only the leaf forecasts of ``base`` (level, key, *by, yhat) and sum them."""
    leaves = base.where(F.col("level") == leaf_level(levels)).select(F.col("key").alias("id"), *by, "yhat")
    return aggregate(with_keys(leaves, meta), ["yhat"], by, levels)


def proportions(history: DataFrame) -> DataFrame:
    """(id, share): each leaf's mean over the sum of means; equal shares when nothing sold."""
    means = history.groupBy("id").agg(F.avg("sales").alias("_mean"))
    # one row, read as a scalar subquery
    whole = means.agg(F.struct(F.sum("_mean").alias("total"), F.count("*").alias("leaves"))).scalar()
    sold = F.col("_whole.total")
    return means.withColumn("_whole", whole).select(
        "id",
        F.when(sold > 0, F.col("_mean") / F.nullif(sold, F.lit(0.0))).otherwise(1.0 / F.col("_whole.leaves")).alias("share"),
    )


def top_down(
    base: DataFrame,
    shares: DataFrame,
    meta: DataFrame,
    levels: Sequence[Level] = LEVELS,
) -> DataFrame:
    """Spread the total forecast over the leaves by their shares, then sum.

    The total has one row per day. It travels to the leaves as one array, so
    every leaf emits its own days and no product join is needed.
    """
    total = base.where(F.col("level") == "total").agg(F.collect_list(F.struct("d", "yhat")).alias("_days"))
    spread = shares.withColumn("_total", F.explode(total.scalar()))
    leaves = spread.select("id", F.col("_total.d").alias("d"), (F.col("share") * F.col("_total.yhat")).alias("yhat"))
    return aggregate(with_keys(leaves, meta), ["yhat"], ("d",), levels)


def coherence_error(
    values: DataFrame, meta: DataFrame, by: Sequence[str] = ("d",), levels: Sequence[Level] = LEVELS
) -> DataFrame:
    """One row, ``coherence_error``: the largest gap between a node and the sum of its leaves."""
    implied = bottom_up(values, meta, by, levels).withColumnRenamed("yhat", "_implied")
    gaps = values.join(implied, ["level", "key", *by])
    return gaps.agg(F.max(F.abs(F.col("yhat") - F.col("_implied"))).alias("coherence_error"))


def flat_node_base(
    leaf_history: DataFrame,
    leaf_forecast: DataFrame,
    train_end: int,
    horizon: int,
    days: int = 28,
    levels: Sequence[Level] = LEVELS,
) -> DataFrame:
    """An incoherent base (level, key, d, yhat).

    Upper nodes repeat the mean of their last ``days`` days; leaves take the
    given forecast (id, d, yhat), null as 0.
    """
    recent = day_slice(leaf_history, train_end - days + 1, train_end)
    node_history = aggregate(recent, ["sales"], ("d",), levels)
    steps = F.sequence(F.lit(train_end + 1), F.lit(train_end + horizon))
    upper = (
        node_history.where(F.col("level") != leaf_level(levels))
        .groupBy("level", "key")
        .agg((F.sum("sales") / F.lit(float(days))).alias("yhat"))
        .select("level", "key", F.explode(steps).alias("d"), "yhat")
    )
    leaves = leaf_forecast.select(
        F.lit(leaf_level(levels)).alias("level"),
        F.col("id").alias("key"),
        "d",
        F.coalesce("yhat", F.lit(0.0)).alias("yhat"),
    )
    return upper.unionByName(leaves)


def regroup_to_shelves(rows: DataFrame, values: Sequence[str], by: Sequence[str] = ("d",)) -> DataFrame:
    """Leaf rows as store x department leaves of the upper levels, values summed.

    The new id is the store_department key, so nodes of both hierarchies meet by key.
    """
    keys = ["state_id", "store_id", "cat_id", "dept_id"]
    return rows.groupBy(*keys, *by).agg(*[F.sum(v).alias(v) for v in values]).withColumn("id", _key(("store_id", "dept_id")))


def shelf_meta(meta: DataFrame) -> DataFrame:
    """One row per store x department leaf."""
    keys = ["state_id", "store_id", "cat_id", "dept_id"]
    return meta.select(*keys).distinct().withColumn("id", _key(("store_id", "dept_id")))


VARIANCE_FLOOR = 1e-6


def residuals(node_history: DataFrame) -> DataFrame:
    """(level, key, d, resid): history less the node's own mean."""
    means = node_history.groupBy("level", "key").agg(F.avg("sales").alias("_mean"))
    joined = node_history.join(means, ["level", "key"])
    return joined.select("level", "key", "d", (F.col("sales") - F.col("_mean")).alias("resid"))


def residual_variance(node_history: DataFrame, floor: float = VARIANCE_FLOOR) -> DataFrame:
    """(level, key, variance): population variance of the history around its mean, plus a floor."""
    return node_history.groupBy("level", "key").agg((F.var_pop("sales") + floor).alias("variance"))


def level_wape(
    forecasts: DataFrame, actuals: DataFrame, by: Sequence[str] = ("method",)
) -> DataFrame:
    """(*by, level, wape) from node forecasts (.., yhat) and node actuals (.., sales)."""
    joined = forecasts.join(actuals, ["level", "key", "d"])
    error = F.sum(F.abs(F.col("yhat") - F.col("sales")))
    return joined.groupBy(*by, "level").agg((error / F.nullif(F.sum(F.abs("sales")), F.lit(0)).cast("double")).alias("wape"))


def mean_level_wape(per_level: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """(*by, mean_wape): levels count equally."""
    return per_level.groupBy(*by).agg(F.avg("wape").alias("mean_wape"))


def stack(parts: dict[str, DataFrame], name: str = "method") -> DataFrame:
    """Union of equal tables with a column telling them apart."""
    tagged: Iterable[DataFrame] = [df.withColumn(name, F.lit(label)) for label, df in parts.items()]
    out = None
    for df in tagged:
        out = df if out is None else out.unionByName(df)
    return out
