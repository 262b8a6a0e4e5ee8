"""Daily bars and companion tables from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.panel import sym


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a day and user: first, highest, lowest, last and summed value. Values are
    added one by one in the order of the file's rows, as a scan does: a sum of doubles
    depends on that order, and thresholds on volume decide by its last bit."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    e = events(spark, sf_dir).where("value > 0").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("symbol"), "ts", "value", *place)
    w = Window.partitionBy("date", "symbol").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumns({"sum": F.sum("value").over(w), "k": F.count("*").over(w)})
    return e.groupBy("date", "symbol").agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.max_by("sum", "k").alias("volume"),
    )


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("daily_return", F.col("close") / F.lag("close").over(sym()) - 1)


def benchmark_returns(panel: DataFrame) -> DataFrame:
    """The mean daily return of each date, 0 on the first."""
    return panel.groupBy("date").agg(F.coalesce(F.avg("daily_return"), F.lit(0.0)).alias("benchmark_return"))


def effective_events(spark: SparkSession, sf_dir: str, kind: str = "signup") -> DataFrame:
    """symbol, effective_date, value: the latest event of a kind each symbol-day."""
    e = events(spark, sf_dir).where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("effective_date")).agg(F.max_by("value", "ts").alias("value"))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
