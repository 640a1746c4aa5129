"""Stage tables: the panel and the features, written once and read by later stages.

A flow that passes over the panel several times reads it from a table in the
shared folder instead of deriving it again. The table is written once per
session and source folder; ``rebuild=True`` writes it anew after the source
has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandloom.operators import calendar
from demandloom.plans import retail
from demandloom.plans.features import build_features
from demandloom.session import scratch_path
from demandloom.sources import tables

_written: dict[tuple[str, str, str], str] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, write, rebuild: bool) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if rebuild or key not in _written:
        path = scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def panel_table(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """The panel, partitioned by block of days."""
    path = _stage(
        spark, sf_dir, "panel", lambda p: tables.write_panel(retail.panel(spark, sf_dir), p), rebuild
    )
    return spark.read.parquet(path)


def feature_table(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """The feature table, partitioned by store."""

    def write(path: str) -> None:
        events = calendar.event_days(retail.event_calendar(spark, sf_dir))
        tables.write_features(build_features(panel_table(spark, sf_dir), events), path)

    return tables.read_features(spark, _stage(spark, sf_dir, "features", write, rebuild))
