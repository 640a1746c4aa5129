"""Headline timings as one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local threads. Stages that write a
table (panel_build, feature_build) are always built anew; the queries after
them read the stage tables, as a flow would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from demandloom.catalog import ENTRIES
from demandloom.plans import stages
from demandloom.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = [
    "pn_violations",
    "ft_lags",
    "ft_rolling_mean",
    "ft_rolling_median",
    "ft_ewm",
    "pr_promotion",
    "fc_all_baselines",
    "fc_linear_folds",
    "fc_quantiles",
    "me_backtest",
    "me_node_scales",
    "me_weighted_rmsse",
    "me_quantile_report",
    "hi_aggregate",
    "hi_level_wape",
    "hi_mint_diag",
    "an_promo_elasticity",
    "an_error_taxonomy",
    "an_winner_share",
    "tw_cut_windows",
    "ed_headline",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        int(CPUS),
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    timed("panel_build", lambda: stages.panel_table(spark, SF_DIR, rebuild=True))
    timed("feature_build", lambda: stages.feature_table(spark, SF_DIR, rebuild=True))
    for name in QUERIES:
        timed(name, lambda: _run(ENTRIES[name].run(spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
