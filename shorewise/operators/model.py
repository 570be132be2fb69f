"""The mean-speed model: each region moves on at its mean step speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREDICTION = "future_distance_to_erosion_border"


def mean_step_speed(df: DataFrame, key: str = "location_id", time: str = "ahn_version", value: str = "distance_to_erosion_border") -> DataFrame:
    """(key, erosion_speed): mean of the steps' changes by their times; null with one row or a null step."""
    w = Window.partitionBy(key).orderBy(time)
    steps = df.select(key, F.row_number().over(w).alias("n"), F.try_divide((F.col(value) - F.lag(value).over(w)).cast("double"), (F.col(time) - F.lag(time).over(w)).cast("double")).alias("speed")).groupBy(key)
    rows = steps.agg(F.count(F.when(F.col("n") > 1, 1)).alias("steps"), F.count("speed").alias("known"), F.avg("speed").alias("mean"))
    return rows.select(key, F.when((F.col("steps") > 0) & (F.col("steps") == F.col("known")), F.col("mean")).alias("erosion_speed"))


def predict(df: DataFrame, model: DataFrame, steps: int, key: str = "location_id", time: str = "ahn_version", value: str = "distance_to_erosion_border", strict: bool = True) -> DataFrame:
    """Keys and the value moved on by 1 to `steps` steps. With an unknown region nothing is predicted if strict, else that region isn't."""
    rows = df.join(model, key)
    if strict:
        unknown = df.join(model, key, "left_anti").agg((F.count(F.lit(1)) == 0).alias("__all_known"))
        rows = rows.join(F.broadcast(unknown), F.col("__all_known")).drop("__all_known")
    return rows.select(key, time, *[(F.col(value) + k * F.col("erosion_speed")).alias(f"{PREDICTION}_{k}") for k in range(1, steps + 1)])


def unpivot_prediction(prediction: DataFrame, start_year: int = 2024, keys: tuple[str, ...] = ("location_id", "ahn_version")) -> DataFrame:
    """(keys, distance_to_erosion, timestamp): one row per predicted step, the step's number added to the year."""
    columns = [c for c in prediction.columns if c.startswith(PREDICTION)]
    long = prediction.unpivot(list(keys), columns, "time_column", "distance_to_erosion")
    year = F.element_at(F.split("time_column", "_"), -1).cast("int") + start_year
    return long.select(*keys, "distance_to_erosion", F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("timestamp"))


def latest(df: DataFrame, time: str = "ahn_version") -> DataFrame:
    """Rows of the latest time of all."""
    return df.join(F.broadcast(df.agg(F.max(time).alias("__last"))), F.col(time) == F.col("__last")).drop("__last")


class MeanSpeedModel:
    """Holds the speeds; training again needs retrain=True."""

    def __init__(self, data: DataFrame | None = None, steps: int = 3, key: str = "location_id", time: str = "ahn_version", value: str = "distance_to_erosion_border"):
        self.data, self.steps, self.names, self.speeds = data, steps, {"key": key, "time": time, "value": value}, None

    def train(self, retrain: bool = False) -> MeanSpeedModel:
        if self.speeds is None or retrain:
            self.speeds = mean_step_speed(self.data, **self.names)
        return self

    def predict(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """An untrained model predicts nothing."""
        n = self.names
        if self.speeds is None:
            return df.where(F.lit(False)).select(n["key"], n["time"], *[F.lit(None).cast("double").alias(f"{PREDICTION}_{k}") for k in range(1, self.steps + 1)])
        return predict(df, self.speeds, self.steps, strict=strict, **n)

    def save(self, path: str, keep_training_data: bool = False) -> None:
        """Writes the speeds, and the training data if wanted; the model itself stays as it is."""
        self.train().speeds.write.mode("overwrite").parquet(f"{path}/speeds")
        if keep_training_data:
            self.data.write.mode("overwrite").parquet(f"{path}/training_data")

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_training_data: bool = False, **options) -> MeanSpeedModel:
        model = cls(spark.read.parquet(f"{path}/training_data") if with_training_data else None, **options)
        model.speeds = spark.read.parquet(f"{path}/speeds")
        return model
