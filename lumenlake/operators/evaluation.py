"""Retrieval metrics for each query and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import K_VALUES
from .search import as_queries, top_images, top_products


def reciprocal_rank(first_rank: Column) -> Column:
    """0 without a positive."""
    return F.coalesce(F.lit(1.0) / first_rank, F.lit(0.0))


def hit(first_rank: Column, k: int) -> Column:
    return F.coalesce((first_rank <= k).cast("double"), F.lit(0.0))


def ranked_metrics(ranking: DataFrame, totals: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """ranking: query_id, rank, is_positive; totals: query_id, n_positive (> 0) and what else is to be kept.
    Precision divides by k whatever was found; queries without a hit in the ranking count with zeros."""
    found = ranking.where("is_positive").groupBy("query_id").agg(F.min("rank").alias("first_rank"), *(F.sum((F.col("rank") <= k).cast("double")).alias(f"n{k}") for k in ks))
    rows = totals.join(found, "query_id", "left")
    n = {k: F.coalesce(F.col(f"n{k}"), F.lit(0.0)) for k in ks}
    columns = [hit(F.col("first_rank"), k).alias(f"hit{k}") for k in ks]
    columns += [(n[k] / k).alias(f"precision{k}") for k in ks]
    columns += [(n[k] / F.col("n_positive")).alias(f"recall{k}") for k in ks]
    return rows.select(*totals.columns, "first_rank", reciprocal_rank(F.col("first_rank")).alias("rr"), *columns)


def means(rows: DataFrame, keys: list[str], ks: tuple[int, ...] = K_VALUES, sets: bool = False) -> DataFrame:
    """Means of every metric by keys, in one pass; with sets also over all rows (a null key). Of no rows they are 0."""
    metrics = [f"{m}{k}" for m in ("hit", "precision", "recall") for k in ks]
    mean = lambda m: F.coalesce(F.round(F.avg(m), 6), F.lit(0.0))
    out = [F.count("*").alias("valid_queries"), *(mean(m).alias(m) for m in metrics), mean("rr").alias("mrr")]
    return (rows.groupingSets([[], [F.col(k) for k in keys]], *map(F.col, keys)) if sets else rows.groupBy(*keys)).agg(*out)


def evaluable(gallery: DataFrame) -> DataFrame:
    """query_id, product_id, category, n_positive of images whose product has another image."""
    sizes = gallery.groupBy("product_id").agg((F.count("*") - 1).alias("n_positive")).where("n_positive > 0")
    return gallery.select(F.col("image_id").alias("query_id"), "product_id", "category", "split").join(sizes, "product_id")


def loo_products(gallery: DataFrame, k: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """Leave-one-image-out, products pooled by their best image: the metrics of each query (one positive product)."""
    totals = evaluable(gallery)
    if queries is not None:
        totals = totals.join(queries.select("query_id"), "query_id", "left_semi")
    asked = as_queries(gallery).join(totals.select("query_id"), "query_id", "left_semi")
    hits = top_products(asked, gallery, k)
    ranking = hits.join(totals.select("query_id", F.col("product_id").alias("own")), "query_id").withColumn("is_positive", F.col("product_id") == F.col("own"))
    return ranked_metrics(ranking, totals.withColumn("n_positive", F.lit(1)))


def loo_diagnostics(per_query: DataFrame, gallery: DataFrame) -> DataFrame:
    """Counts, and first ranks over the queries that found their product."""
    singles = gallery.groupBy("product_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("products"), F.sum((F.col("n") == 1).cast("long")).alias("excluded_queries"))
    f = F.col("first_rank")
    found = per_query.agg(
        F.count("*").alias("valid_queries"), F.count(f).alias("found_queries"), F.sum(f.isNull().cast("long")).alias("missed_queries"), F.round(F.avg(f), 6).alias("mean_first_rank"),
        F.expr("median(first_rank)").alias("median_first_rank"), F.min(f).cast("long").alias("min_first_rank"), F.max(f).cast("long").alias("max_first_rank"),
    )
    return found.crossJoin(singles)


def loo_images(gallery: DataFrame, k: int = 10) -> DataFrame:
    """Leave-one-out over images: the top k images collapse to products in the order they are first seen, so fewer
    than k products are ranked (short_ranking)."""
    totals = evaluable(gallery)
    hits = top_images(as_queries(gallery).join(totals.select("query_id"), "query_id", "left_semi"), gallery, k)
    products = hits.groupBy("query_id", "product_id").agg(F.min("rank").alias("first"))
    ranked = products.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    ranked = ranked.join(totals.select("query_id", F.col("product_id").alias("own")), "query_id").withColumn("is_positive", F.col("product_id") == F.col("own"))
    width = ranked.groupBy("query_id").agg(F.count("*").alias("unique_products"))
    rows = ranked_metrics(ranked, totals.withColumnRenamed("n_positive", "positive_images").withColumn("n_positive", F.lit(1)))
    return rows.join(width, "query_id", "left").withColumn("short_ranking", F.coalesce("unique_products", F.lit(0)) < k)


def split_evaluation(gallery: DataFrame, split: str) -> DataFrame:
    """Every image of a split asks the rest of the split; all images of its product are positives."""
    part = gallery.where(F.col("split") == split)
    totals = evaluable(part)
    hits = top_images(as_queries(part).join(totals.select("query_id"), "query_id", "left_semi"), part, max(K_VALUES))
    ranking = hits.join(totals.select("query_id", F.col("product_id").alias("own")), "query_id").withColumn("is_positive", F.col("product_id") == F.col("own"))
    return ranked_metrics(ranking, totals)


def with_all_categories(by_category: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Categories without valid queries get zeros."""
    names = by_category.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return names.join(by_category, "category", "left").fillna(0)


def category_evaluation(gallery: DataFrame, split: str, k: int = 10) -> DataFrame:
    """Products of the query's category are the positives (for splits whose groups have one image each)."""
    part = gallery.where(F.col("split") == split)
    names = part.groupBy("product_id").agg(F.first("category").alias("found"))
    totals = part.select(F.col("image_id").alias("query_id"), "category").withColumn("n_positive", F.lit(1))
    hits = top_products(as_queries(part), part, k).join(names, "product_id").join(totals.select("query_id", F.col("category").alias("own")), "query_id")
    return ranked_metrics(hits.withColumn("is_positive", F.col("found") == F.col("own")), totals)


TRANSFORMS = ("flip", "scale", "zero", "shift", "swap")


def transformed(vector: str, kind: str) -> Column:
    """Deterministic disturbances of a vector that stand in for image transforms."""
    x = F.col(vector)
    return {
        "flip": F.transform(x, lambda v, i: F.when(i < 8, -v).otherwise(v)),
        "scale": F.transform(x, lambda v: v * 3.0),
        "zero": F.transform(x, lambda v, i: F.when(i >= 32, F.lit(0.0)).otherwise(v)),
        "shift": F.transform(x, lambda v: v + 0.05),
        "swap": F.reverse(x),
    }[kind]


def robustness(gallery: DataFrame, kinds: tuple[str, ...] = TRANSFORMS) -> DataFrame:
    """Mean hits of disturbed queries that look for their own product in the whole gallery, for each transform: one
    search for all of them, a query for each image and transform."""
    n = len(kinds)
    vectors = F.array(*(F.struct(F.lit(k).alias("t"), transformed("embedding", kind).alias("embedding")) for k, kind in enumerate(kinds)))
    asked = gallery.select("image_id", "product_id", F.inline(vectors)).select((F.col("image_id") * n + F.col("t")).alias("query_id"), "t", F.col("product_id").alias("own"), "embedding")
    own = asked.select("query_id", "own", F.element_at(F.array(*map(F.lit, kinds)), F.col("t") + 1).alias("transform"))
    ranking = top_products(asked, gallery, 10, False).join(own, "query_id").withColumn("is_positive", F.col("product_id") == F.col("own"))
    rows = ranked_metrics(ranking.drop("transform"), own.select("query_id", "transform", F.lit(1).alias("n_positive")))
    return rows.groupBy("transform").agg(F.count("*").alias("queries"), *(F.round(F.avg(f"hit{k}"), 6).alias(f"hit{k}") for k in K_VALUES), F.round(F.avg("rr"), 6).alias("mrr"))


def loo_images_report(gallery: DataFrame, k: int = 10) -> DataFrame:
    """loo_images() over all and by category: queries, products with and without evaluable queries, means, how many
    rankings are short, and the first ranks of queries that found their product."""
    rows = loo_images(gallery, k).withColumn("category", F.col("category"))
    sizes = gallery.groupBy("product_id").agg(F.count("*").alias("n"), F.min("category").alias("category"))
    groups = sizes.groupingSets([[], [F.col("category")]], F.col("category")).agg(F.sum((F.col("n") > 1).cast("long")).alias("evaluated_groups"), F.sum((F.col("n") == 1).cast("long")).alias("excluded_groups"))
    found = rows.groupingSets([[], [F.col("category")]], F.col("category")).agg(
        F.count("*").alias("queries"), *(F.round(F.avg(f"hit{x}"), 6).alias(f"hit{x}") for x in K_VALUES), F.round(F.avg("rr"), 6).alias("mrr"), F.sum(F.col("short_ranking").cast("long")).alias("short_rankings"), F.round(F.avg("first_rank"), 6).alias("mean_first_rank")
    )
    return groups.join(found.withColumnRenamed("category", "_c"), F.col("category").eqNullSafe(F.col("_c")), "left").drop("_c")


def nearest_neighbour_accuracy(gallery: DataFrame) -> DataFrame:
    own = gallery.select(F.col("image_id").alias("query_id"), F.col("product_id").alias("own"))
    near = top_images(as_queries(gallery), gallery, 1).join(own, "query_id")
    return near.agg(F.count("*").alias("queries"), F.sum((F.col("product_id") == F.col("own")).cast("long")).alias("correct"), F.round(F.avg((F.col("product_id") == F.col("own")).cast("double")), 6).alias("accuracy"))
