"""Feature-based forecasts: least squares, boosted trees on squared error and on Tweedie deviance, Tweedie regression.

MLlib's trees minimise squared error and split on indexed categories, its Tweedie model is a generalised linear
one; trees on Tweedie deviance are those of ``boosting``. None claims the scores of a dedicated boosting library.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.operators import boosting
from demandloom.operators.forecast import not_negative
from demandloom.operators.panel import day_slice
from demandloom.session import scratch_path

# Training spans in days and the Tweedie power.
LINEAR_TRAIN_DAYS = 180
MIN_BINS = 64
TREE_TRAIN_DAYS = 365
VALID_DAYS = 28
TWEEDIE_POWER = 1.1
LINEAR_LOOKBACK = 200
LOOKBACK_MARGIN = 10

# Categories with few values; the item enters through its historical mean.
CATEGORIES = ("dept_id", "cat_id", "store_id", "state_id")


def lookback_days(model: str, train_days: int = TREE_TRAIN_DAYS) -> int | None:
    """Days of features a model needs before its earliest cutoff.

    None: the model needs no features.
    """
    if model == "linear_reg":
        return LINEAR_LOOKBACK
    if model in ("boosted_trees", "tweedie", "tweedie_trees"):
        return train_days + LOOKBACK_MARGIN
    return None


def training_rows(features: DataFrame, train_end: int, train_days: int, valid_days: int = 0) -> DataFrame:
    """The last ``train_days`` days; ``is_valid`` marks the final ``valid_days`` of them."""
    rows = day_slice(features, train_end - train_days + 1, train_end)
    return rows.withColumn("is_valid", F.col("d") > train_end - valid_days)


def _as_numbers(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    return features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def _fit(rows: DataFrame, stages: list, columns: Sequence[str], categories: Sequence[str] = ()) -> FittedRegression:
    """Fit on kept rows: the solvers pass over them many times.

    Rows lost with an executor are computed again from the feature table.
    """
    needed = [c for c in rows.columns if c in {*columns, *categories, "sales", "is_valid"}]
    kept = rows.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return FittedRegression(Pipeline(stages=stages).fit(kept), list(columns))
    finally:
        kept.unpersist()


@dataclass
class FittedRegression:
    model: PipelineModel
    columns: list[str]

    def predict(self, features: DataFrame, future: DataFrame) -> DataFrame:
        """(id, d, yhat >= 0) for the rows of ``future``; absent features count as 0."""
        rows = future.select("id", "d").join(features, ["id", "d"], "left")
        scored = self.model.transform(_as_numbers(rows, self.columns))
        return scored.select("id", "d", not_negative(F.col("prediction")).alias("yhat"))

    def nodes(self) -> DataFrame:
        """(tree, node, feature, gain): the fitted trees as a table; feature and gain are null for leaves.

        The model is written to the shared folder, where its nodes are a table of their own.
        """
        spark = SparkSession.active()
        path = scratch_path(spark, "trees")
        self.model.stages[-1].save(path)
        split = F.col("nodeData.split.featureIndex")
        inner = F.col("nodeData.leftChild") >= 0
        names = F.array(*map(F.lit, self.model.stages[-2].getInputCols()))
        return spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"),
            F.col("nodeData.id").alias("node"),
            F.when(inner, F.get(names, split)).alias("feature"),
            F.when(inner, F.col("nodeData.gain")).alias("gain"),
        )

    def importance(self) -> DataFrame:
        """(feature, gain, splits), largest first; trees only. The gain is MLlib's, which sums to 1."""
        gains = self.model.stages[-1].featureImportances.toArray()
        names = self.model.stages[-2].getInputCols()
        rows = [(name, float(gain)) for name, gain in zip(names, gains)]
        table = SparkSession.active().createDataFrame(rows, "feature string, gain double")
        counted = boosting.count_splits(self.nodes(), table.select("feature")).select("feature", "splits")
        return table.join(counted, "feature").orderBy(F.desc("gain"), "feature")


def fit_linear(features: DataFrame, columns: Sequence[str], train_end: int, train_days: int = LINEAR_TRAIN_DAYS) -> FittedRegression:
    """Ordinary least squares by normal equations: one pass over the training rows."""
    rows = _as_numbers(training_rows(features, train_end, train_days), columns)
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol="sales", solver="normal"),
    ]
    return _fit(rows, stages, columns)


def fit_trees(
    features: DataFrame,
    columns: Sequence[str],
    train_end: int,
    categories: Sequence[str] = CATEGORIES,
    train_days: int = TREE_TRAIN_DAYS,
    valid_days: int = VALID_DAYS,
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.05,
    seed: int = 42,
) -> FittedRegression:
    """Boosted trees on all horizon days at once.

    The last ``valid_days`` only decide when to stop. Rows and features are
    subsampled at 0.8. Categories are never split by more bins than they have
    values, whatever their number.
    """
    rows = _as_numbers(training_rows(features, train_end, train_days, valid_days), columns)
    categories = list(categories)
    sizes = rows.agg(*[F.count_distinct(c) for c in categories]).first() if categories else ()
    # one more for values that the indexer has not seen
    bins = max([MIN_BINS, *(n + 1 for n in sizes)])
    indexed = [f"_{c}_code" for c in categories]
    stages = [
        *(
            [StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep")]
            if categories
            else []
        ),
        VectorAssembler(inputCols=[*columns, *indexed], outputCol="_x"),
        GBTRegressor(
            featuresCol="_x", labelCol="sales", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
            subsamplingRate=0.8, featureSubsetStrategy="0.8", validationIndicatorCol="is_valid",
            maxBins=bins, minInstancesPerNode=20,
        ),
    ]
    return _fit(rows, stages, columns, categories)


def fit_tweedie(
    features: DataFrame,
    columns: Sequence[str],
    train_end: int,
    train_days: int = TREE_TRAIN_DAYS,
    power: float = TWEEDIE_POWER,
    ridge: float = 0.01,
) -> FittedRegression:
    """Tweedie regression with a log link on standardised features."""
    rows = _as_numbers(training_rows(features, train_end, train_days), columns)
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        GeneralizedLinearRegression(
            featuresCol="_x", labelCol="sales", family="tweedie", variancePower=power, linkPower=0.0,
            regParam=ridge, maxIter=50,
        ),
    ]
    return _fit(rows, stages, columns)


def fit_tweedie_trees(
    features: DataFrame,
    columns: Sequence[str],
    train_end: int,
    categories: Sequence[str] = CATEGORIES,
    train_days: int = TREE_TRAIN_DAYS,
    valid_days: int = VALID_DAYS,
    power: float = TWEEDIE_POWER,
    **options,
) -> boosting.Ensemble:
    """Boosted trees on Tweedie deviance, on all horizon days at once; the last ``valid_days`` only decide when to stop.

    ``options`` go to ``boosting.boost``. Missing features stay missing, categories are split as sets.
    """
    rows = training_rows(features, train_end, train_days, valid_days)
    return boosting.boost(rows, columns, categories, valid=F.col("is_valid"), loss=boosting.Tweedie(power), **options)
