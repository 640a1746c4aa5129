"""Features from the target. At day t they see sales up to t - horizon only.

Rolling mean, deviation and zero share come from running totals: a total up to
``shift`` days ago minus the total up to ``shift + window`` days ago. The totals
are longs or decimals and so exact, and a 90-day window costs as little as a
7-day one. Only the median needs the values themselves: the longest window is
gathered once per row and the shorter ones are its tails.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions.windows import at_lag, ratio, trailing, up_to

# The feature recipe.
HORIZON = 28
LAGS = (28, 35, 42, 49, 56, 364)
WINDOWS = (7, 28, 90)
STATS = ("mean", "std", "median", "zero_frac")
EWM_ALPHAS = (0.1,)

# Powers inside a block of days; exp(690) is the end of a double's range.
_MAX_EXPONENT = 600.0


def _refuse_leak(kind: str, offsets: Iterable[int], horizon: int) -> None:
    early = sorted(o for o in offsets if o < horizon)
    if early:
        raise ValueError(f"{kind} {early} would read sales inside the {horizon}-day horizon")


def lag_features(df: DataFrame, lags: Iterable[int] = LAGS, horizon: int = HORIZON) -> DataFrame:
    """``sales_lag_L``: sales L days ago, as a double like every other model input."""
    lags = tuple(lags)
    _refuse_leak("lags", lags, horizon)
    return df.withColumns({f"sales_lag_{lag}": at_lag("sales", lag).cast("double") for lag in lags})


def _min_periods(window: int) -> int:
    return max(window // 2, 2)


def _whole(n: Column) -> Column:
    return n.cast("int")


def _middle(ordered: Column) -> Column:
    """Median of a sorted array."""
    size = F.size(ordered)
    low, high = F.floor((size + 1) / 2), F.floor(size / 2) + 1
    return (F.element_at(ordered, _whole(low)) + F.element_at(ordered, _whole(high))) / 2.0


def rolling_features(
    df: DataFrame,
    windows: Iterable[int] = WINDOWS,
    stats: Iterable[str] = STATS,
    shift: int = HORIZON,
    horizon: int = HORIZON,
) -> DataFrame:
    """``r_<stat>_<window>`` over the window that ends ``shift`` days ago.

    Null while fewer than half the window's days (2 at least) have sales.
    Totals are exact: whole units as longs, other sales as decimals to the sixth place.
    """
    _refuse_leak("rolling shift", [shift], horizon)
    windows, stats = tuple(windows), tuple(stats)
    whole = isinstance(df.schema["sales"].dataType, T.IntegralType)
    units = F.col("sales").cast("long" if whole else "decimal(18,6)")
    totals = {
        "_n": F.count(units),
        "_s": F.sum(units),
        "_q": F.sum(units * units),
        "_z": F.count_if(units == 0),
    }
    marks = sorted({shift, *(shift + w for w in windows)})
    running = {
        f"{name}{mark}": F.coalesce(total.over(up_to(mark)), F.lit(0).cast("long"))
        for name, total in totals.items()
        for mark in marks
    }

    def inside(name: str, window: int) -> Column:
        return F.col(f"{name}{shift}") - F.col(f"{name}{shift + window}")

    made = {}
    for w in windows:
        n, s, q = inside("_n", w), inside("_s", w), inside("_q", w)
        values = {
            "mean": s.cast("double") / n,
            "std": F.sqrt(ratio((n * q - s * s).cast("double"), n * (n - 1))),
            "zero_frac": inside("_z", w) / n,
        }
        made |= {f"r_{stat}_{w}": F.when(n >= _min_periods(w), values[stat]) for stat in stats if stat in values}
    out = df.withColumns(running).withColumns(made)
    if "median" in stats:
        # a window of its own, so that the code generated for either part stays small enough to be compiled
        out = out.drop(*[c for c in running if not c.startswith("_n")])
        out = out.withColumn("_recent", F.collect_list(units).over(trailing(max(windows), shift)))
        # the gathered values are in day order, so the last n of them are the window's
        tails = {
            f"_tail{w}": F.when(
                inside("_n", w) >= _min_periods(w),
                F.sort_array(F.slice("_recent", F.size("_recent") - _whole(inside("_n", w)) + 1, _whole(inside("_n", w)))),
            )
            for w in windows
        }
        out = out.withColumns(tails).withColumns({f"r_median_{w}": _middle(F.col(f"_tail{w}")) for w in windows})
    return out.select(*df.columns, *[f"r_{stat}_{w}" for w in windows for stat in stats])


def ewm_name(alpha: float) -> str:
    return "ewm_a" + str(alpha).replace("0.", "")


def ewm_features(
    df: DataFrame, alphas: Iterable[float] = EWM_ALPHAS, shift: int = HORIZON, horizon: int = HORIZON
) -> DataFrame:
    """Bias-corrected exponentially weighted mean of the sales up to ``shift`` days ago, for series of any length.

    With k = 1 - alpha the mean on day t is sum(x k^(t-i)) / sum(k^(t-i)). Days are cut into blocks, short enough that
    k^-i counted from a block's start stays inside a double. A block is summed up as (block, weight, weighted sum); two such
    sums combine by decaying the earlier one, so a day adds its block so far to the fold of all blocks before it. Days
    without sales leave the mean as it is.
    """
    _refuse_leak("ewm shift", [shift], horizon)
    out = df
    for alpha in alphas:
        out = _ewm_of_days(out, alpha).withColumn(ewm_name(alpha), F.last("_ewm", True).over(up_to(shift))).drop("_ewm")
    return out


def _ewm_of_days(df: DataFrame, alpha: float) -> DataFrame:
    """``_ewm``: the mean up to and including each day that has sales, null on other days."""
    growth = -math.log1p(-alpha)
    days = max(1, int(_MAX_EXPONENT / growth))
    known = F.col("sales").isNotNull()
    weight = F.when(known, F.exp((F.col("d") - F.col("_block") * days) * growth))
    out = df.withColumn("_block", F.floor(F.col("d") / days).cast("long"))
    out = out.withColumns({"_w": weight, "_wx": weight * F.col("sales")})
    in_block = Window.partitionBy("id", "_block").orderBy("d")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    whole = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumns(
        {
            "_sum": F.struct("_block", F.sum("_w").over(whole).alias("w"), F.sum("_wx").over(whole).alias("wx")),
            "_first": F.row_number().over(in_block) == 1,
            "_w": F.sum("_w").over(so_far), "_wx": F.sum("_wx").over(so_far),
        }
    )
    # one entry per earlier block that has sales
    earlier = Window.partitionBy("id").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    blocks = F.collect_list(F.when(F.col("_first") & F.col("_sum.w").isNotNull(), F.col("_sum"))).over(earlier)
    decay = lambda blocks: F.exp(-growth * days * blocks)
    nothing = F.struct(F.lit(None).cast("long").alias("block"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"))

    def combine(total: Column, block: Column) -> Column:
        kept = F.coalesce(decay(block["_block"] - total["block"]), F.lit(0.0))
        return F.struct(
            block["_block"].alias("block"), (total["w"] * kept + block["w"]).alias("w"), (total["wx"] * kept + block["wx"]).alias("wx")
        )

    out = out.withColumn("_before", F.aggregate(blocks, nothing, combine))
    reach = F.coalesce(decay(F.col("_block") - F.col("_before.block")), F.lit(0.0))
    mean = (F.col("_wx") + F.col("_before.wx") * reach) / (F.col("_w") + F.col("_before.w") * reach)
    return out.withColumn("_ewm", F.when(known, mean)).select(*df.columns, "_ewm")


def historical_mean(df: DataFrame, shift: int = HORIZON, horizon: int = HORIZON) -> DataFrame:
    """``hist_mean``: mean of all the series' sales up to ``shift`` days ago."""
    _refuse_leak("expanding shift", [shift], horizon)
    return df.withColumn("hist_mean", F.avg("sales").over(up_to(shift)))


def momentum(df: DataFrame) -> DataFrame:
    """Last week's level against last month's; null when the month sold nothing."""
    month = F.col("r_mean_28")
    return df.withColumn("momentum_7_28", F.when(month > 0, F.col("r_mean_7") / F.nullif(month, F.lit(0.0))))


def target_features(
    df: DataFrame,
    lags: Iterable[int] = LAGS,
    windows: Iterable[int] = WINDOWS,
    stats: Iterable[str] = STATS,
    alphas: Iterable[float] = EWM_ALPHAS,
    shift: int = HORIZON,
    horizon: int = HORIZON,
) -> DataFrame:
    """All features of this module, in their fixed order."""
    out = lag_features(df, lags, horizon)
    out = rolling_features(out, windows, stats, shift, horizon)
    out = ewm_features(out, alphas, shift, horizon)
    return momentum(historical_mean(out, shift, horizon))


def leaked_rows(panel: DataFrame, build, day: int, columns: list[str], horizon: int = HORIZON) -> DataFrame:
    """Rows of ``day`` whose features change when the hidden sales change.

    ``build`` maps a panel to features. Sales in (day - horizon, day] are
    replaced; a horizon-safe build gives an empty result.
    """
    hidden = F.col("d").between(day - horizon + 1, day)
    touched = panel.withColumn("sales", F.when(hidden, F.col("sales") + 1000 + F.col("d")).otherwise(F.col("sales")))
    seen = [build(p).where(F.col("d") == day).select("id", *columns) for p in (panel, touched)]
    return seen[0].exceptAll(seen[1])
