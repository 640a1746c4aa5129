"""Common handling of input tables: chosen columns, keys of rows, empty and odd values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names; extra columns, whatever their names, go no further."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. Pure ASCII text takes the fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where nested lambdas use it for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage and plan end here, and sizes are known.

    The table lives as long as the session; Spark's file system drops it when that ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm-stage")
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
