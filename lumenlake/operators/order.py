"""Places and running sums over a whole table, without a window that one task has to hold."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Without one, a session of one machine gets a temporary
    one and a cluster an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumenlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(rows: DataFrame) -> DataFrame:
    """rows, computed once and written to the shared folder; the files go once nothing refers to them, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds name: each row's place from 0 in that order. A range-partitioned sort, the partitions' counts, and their
    offsets: the driver sees a number for each partition."""
    placed = settled(rows.sort(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # As many rows as partitions.
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_part", "_id", "_first", "_before")


def numbered_within(rows: DataFrame, key: str, order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """Adds name: each row's place from 0 among those of its key, and size: how many those are. For few keys with many
    rows each, which a window by key would put in as many tasks."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_size"))
    # As many rows as keys.
    before = F.coalesce(F.sum("_size").over(Window.orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), "_size", before.alias("_offset"))
    placed = numbered(rows, [F.col(key).asc_nulls_first(), *order], name).join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")))
    placed = placed.withColumn(name, F.col(name) - F.col("_offset"))
    return (placed.withColumn(size, F.col("_size")) if size else placed).drop("_key", "_size", "_offset")


def running(rows: DataFrame, value: str, sums: list[str], step: float) -> DataFrame:
    """Adds upto_<c>, the sum of c over all rows up to each value, and all_<c>, the whole sum. Rows are dealt by
    value into bins of a width; a window runs in each bin, and one over the bins' totals."""
    dealt = rows.withColumn("_bin", F.floor(F.col(value) / step))
    bins = dealt.groupBy("_bin").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("_bin", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums), *(F.sum(f"_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy("_bin").orderBy(value)
    out = dealt.join(F.broadcast(offsets), "_bin")
    return out.withColumns({f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums}).drop("_bin", *(f"_before_{c}" for c in sums))
