"""The driver's tables as galleries, manifests, fingerprints and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORIES

BITS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, product_id, category_id, category, split, label, embedding (array<double>). Every 50th product is
    a product of one image."""
    e = read(spark, sf_dir, "embeddings")
    product = F.when(F.col("vec_id") % 50 == 7, 1000 + F.col("vec_id")).otherwise(F.col("vec_id") % 100)
    e = e.select(F.col("vec_id").alias("image_id"), product.alias("product_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    e = e.withColumn("category_id", (F.col("product_id") % 5).cast("long"))
    names = F.array(*map(F.lit, CATEGORIES))
    split = F.when(F.col("product_id") % 10 < 8, "train").when(F.col("product_id") % 10 == 8, "valid").otherwise("test")
    return e.select("image_id", "product_id", "category_id", F.element_at(names, F.col("category_id").cast("int") + 1).alias("category"), split.alias("split"), "label", "embedding")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gallery(spark, sf_dir)
    return g.select("image_id", F.concat(F.lit("images/"), "split", F.lit("/"), F.lpad(F.col("image_id").cast("string"), 6, "0"), F.lit(".png")).alias("image_path"), F.col("product_id").alias("group_id"), "category", "category_id", "split", F.lit("dataset1").alias("source"))


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's images with made-up findings of an inspection, by their numbers: some can't be read, some aren't RGB,
    some are flat."""
    i = F.col("image_id")
    readable = i % 37 != 5
    reasons = F.array_compact(F.array(F.when(i % 13 == 0, "near_black"), F.when(i % 17 == 0, "near_white"), F.when((i % 19 == 0) & (i % 13 != 0) & (i % 17 != 0), "near_uniform")))
    rows = manifest(spark, sf_dir).withColumn("readable", readable).withColumn("reasons", F.when(readable, reasons).otherwise(F.array().cast("array<string>")))
    mode = F.when(i % 11 == 0, "RGBA").when(i % 11 == 1, "L").otherwise("RGB")
    status = F.when(~F.col("readable"), "invalid").when(F.size("reasons") > 0, "warning").otherwise("valid")
    return rows.select(
        "image_id", "split", "category", status.alias("status"), "readable", F.when(readable, mode).alias("mode"), F.when(readable, i % 41 != 3).alias("rgb_convertible"),
        F.when(readable, 200 + i % 7 * 10).alias("width"), F.when(readable, 180 + i % 5 * 20).alias("height"), "reasons", F.when(~readable, F.when(i % 74 == 5, "decode_error").otherwise("missing_file")).alias("reason"),
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dataset (parity of the source number), exact_hash, bits (a string of 64) and fp (the same as a long): a
    bit is 1 where a token bucket's count is above the median of all buckets."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("exact_hash"), F.when(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0, "a").otherwise("b").alias("dataset"), "text")
    # A document's tokens are counted where they are read: at most a row for each bucket is shuffled.
    token = d.select("doc_id", "exact_hash", "dataset", F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
    bucket = (F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 2), 16, 10).cast("int") % BITS).alias("bucket")
    counted = token.select("doc_id", "exact_hash", "dataset", bucket).groupBy("doc_id", "exact_hash", "dataset", "bucket").agg(F.count("*").alias("n"))
    rows = counted.groupBy("doc_id", "exact_hash", "dataset").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    # A lambda over an array of one element binds a value that is used more than once.
    counts = F.transform(F.expr(f"sequence(0, {BITS - 1})"), lambda k: F.coalesce(F.col("m")[k], F.lit(0)))
    with_order = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), F.array_sort(c).alias("o")))
    with_median = F.transform(with_order, lambda x: F.struct(x["c"].alias("c"), ((F.element_at(x["o"], BITS // 2) + F.element_at(x["o"], BITS // 2 + 1)) / 2.0).alias("median")))
    bits = F.transform(with_median, lambda x: F.array_join(F.transform(x["c"], lambda n: F.when(n > x["median"], "1").otherwise("0")), ""))[0]
    rows = rows.select("doc_id", "dataset", "exact_hash", bits.alias("bits"))
    high, low = (F.conv(F.substring("bits", k, 32), 2, 10).cast("long") for k in (1, 33))
    return rows.select("doc_id", "dataset", "exact_hash", "bits", F.shiftleft(high, 32).bitwiseOR(low).alias("fp"))
