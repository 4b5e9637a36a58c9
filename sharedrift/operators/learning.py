"""Machine-learning form of the line fit: count predicted from year over all rows."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(df: DataFrame, label: str = "count") -> DataFrame:
    """(label = count, features = [year])."""
    assembled = VectorAssembler(inputCols=["year"], outputCol="features").transform(df)
    return assembled.withColumn("label", F.col(label).cast("double"))


def in_training(*key: str, share: float = 0.7) -> Column:
    """A split that is the same on every run and engine: the row's key hashes into the training share."""
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return F.substring(digest, 1, 4) < F.lit(f"{round(share * 0x10000):04x}")


def random_split(df: DataFrame, share: float = 0.7, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    training, test = df.randomSplit([share, 1 - share], seed)
    return training, test


def train(rows: DataFrame) -> LinearRegressionModel:
    """Closed-form least squares, one distributed pass; the driver receives only the 2x2 moment sums."""
    return LinearRegression(solver="normal", featuresCol="features", labelCol="label").fit(rows)


def predictions(model: LinearRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


def mean_squared_error(predicted: DataFrame) -> DataFrame:
    error = F.col("label") - F.col("prediction")
    return predicted.agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"))
