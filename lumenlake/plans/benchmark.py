"""Timing of plans: warm-ups, repeats, and the series that the latency operators take."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import latency, recommend
from ..operators.selection import with_quantiles


def capped(rows: int, batch: int, warmups: int, batches: int) -> tuple[int, int]:
    """How many warm-up and measured batches fit in one pass over so many rows; warm-ups leave one batch to measure."""
    if rows < 1 or batch < 1 or warmups < 0 or batches < 1:
        raise ValueError("rows, batch and batches must be above 0, warmups at least 0")
    whole = -(-rows // batch)
    first = min(warmups, whole - 1)
    return first, min(batches, whole - first)


def timed(spark: SparkSession, settings: dict[str, Callable[[], DataFrame]], warmups: int = 1, repeats: int = 5) -> DataFrame:
    """(setting, run, value): milliseconds of each measured run of each setting; a run writes all its rows nowhere."""
    rows = []
    for name, make in settings.items():
        for run in range(-warmups, repeats):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            if run >= 0:
                rows.append((name, run, 1000 * (time.perf_counter() - began)))
    return spark.createDataFrame(rows, "setting string, run int, value double")


def throughput(times: DataFrame, images: str) -> DataFrame:
    """times: setting, value (ms) and a column of images in each batch: mean, median and p95, batches and images a
    second."""
    rows = times.groupBy("setting").agg(F.count("*").alias("batches"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.sum(images).alias("images"))
    rows = with_quantiles(rows, times, "value", [0.5, 0.95], "setting")
    second = lambda n: F.try_divide(F.col(n) * 1000.0, F.col("total"))
    return rows.select("setting", "batches", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), second("batches").alias("batches_per_sec"), second("images").alias("images_per_sec"))


def report(times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Percentiles of every setting, and the one that is recommended."""
    stats = latency(times, "value", "setting")
    return stats, recommend(stats, "setting")
