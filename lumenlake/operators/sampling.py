"""Samples for people to look at: images, groups, pairs and failures, chosen by hash, and checks of what was chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import hash_int
from .selection import first_n


def take(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """The first rows by a hash of a key; all of them if there are no more."""
    if count < 0:
        raise ValueError("a sample can't have fewer than 0 rows")
    return first_n(rows, hash_int(seed, F.col(key)), count, [F.col(key)])


def split_images(manifest: DataFrame, split: str, count: int, seed: int = 2026) -> DataFrame:
    return take(manifest.where(F.col("split") == split), "image_id", count, seed)


def train_groups(manifest: DataFrame, count: int, seed: int = 2026) -> DataFrame:
    """All images of so many train groups, of sizes 3 or more, 2 and 1 by turns as long as there are some."""
    rows = manifest.where("split = 'train'")
    sizes = rows.groupBy("group_id").agg(F.least(F.count("*"), F.lit(3)).alias("size"))
    # The first `count` of each size are enough for any turn.
    best = None
    for size in (3, 2, 1):
        some = take(sizes.where(F.col("size") == size), "group_id", count, seed)
        best = some if best is None else best.unionByName(some)
    turn = F.row_number().over(Window.partitionBy("size").orderBy(hash_int(seed, F.col("group_id")), "group_id"))
    chosen = best.withColumn("turn", turn).orderBy("turn", F.desc("size")).limit(count).select("group_id", "turn", "size")
    return rows.join(F.broadcast(chosen), "group_id")


def sample_pairs(pairs: DataFrame, count: int, seed: int = 2026, negative_type: str | None = None, label: int = 1) -> DataFrame:
    rows = pairs.where(F.col("label") == label)
    return take(rows if negative_type is None else rows.where(F.col("negative_type") == negative_type), "pair_id", count, seed)


def balanced_negatives(pairs: DataFrame, count: int, seed: int = 2026) -> DataFrame:
    """Half of one category and half across; what one kind lacks, the other gives."""
    both = None
    for kind in ("same_category", "cross_category"):
        some = sample_pairs(pairs, count, seed, kind, 0)
        both = some if both is None else both.unionByName(some)
    w = Window.partitionBy("negative_type")
    place = F.row_number().over(w.orderBy(hash_int(seed, F.col("pair_id")), "pair_id"))
    own = F.when(F.col("negative_type") == "same_category", F.lit(count // 2)).otherwise(F.lit(count - count // 2))
    # Own places come first, then the rest, one category before across.
    rows = both.withColumn("place", place).withColumn("later", F.col("place") > own)
    return rows.orderBy("later", F.desc("negative_type"), "place").limit(count).drop("place", "later")


def one_image_a_group(manifest: DataFrame, count: int, seed: int = 2026) -> DataFrame:
    """The first image of so many train groups."""
    first = manifest.where("split = 'train'").groupBy("group_id").agg(F.min_by(F.struct(*(c for c in manifest.columns if c != "group_id")), "image_id").alias("r"))
    return take(first, "group_id", count, seed).select("group_id", "r.*")


def selection(manifest: DataFrame, pairs: DataFrame, counts: dict[str, int], seed: int = 2026) -> DataFrame:
    """(kind, id) of everything chosen: train_group (images of whole groups), valid, test, positive, same_category,
    cross_category, augmentation. counts: train_groups, valid, test, positives, negatives, augmentation."""
    row = lambda df, kind, key: df.select(kind if not isinstance(kind, str) else F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    out = row(train_groups(manifest, counts["train_groups"], seed), "train_group", "image_id")
    for split in ("valid", "test"):
        out = out.unionByName(row(split_images(manifest, split, counts[split], seed), split, "image_id"))
    out = out.unionByName(row(sample_pairs(pairs, counts["positives"], seed), "positive", "pair_id"))
    out = out.unionByName(row(balanced_negatives(pairs, counts["negatives"], seed), F.col("negative_type").alias("kind"), "pair_id"))
    return out.unionByName(row(one_image_a_group(manifest, counts["augmentation"], seed), "augmentation", "image_id"))


def selection_violations(chosen: DataFrame, manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, id, violation): ids that don't exist or repeat, images of another split, pairs whose label, groups,
    categories or splits don't fit their kind, and groups of which an image is missing."""
    rows = chosen.withColumn("times", F.count("*").over(Window.partitionBy("kind", "id")))
    m = manifest.select(F.col("image_id").cast("string").alias("id"), "split", "group_id")
    p = pairs.select(F.col("pair_id").alias("id"), "label", F.col("split").alias("pair_split"), (F.col("group_id_1") == F.col("group_id_2")).alias("one_group"), (F.col("category_1") == F.col("category_2")).alias("one_category"))
    rows = rows.join(m, "id", "left").join(p, "id", "left")
    image = F.col("kind").isin("train_group", "valid", "test", "augmentation")
    wanted = F.when(F.col("kind").isin("train_group", "augmentation"), "train").otherwise(F.col("kind"))
    bad = F.array_compact(F.array(
        F.when(F.col("times") > 1, "repeated"),
        F.when(F.when(image, F.col("split").isNull()).otherwise(F.col("label").isNull()), "unknown"),
        F.when(image & (F.col("split") != wanted), "split"),
        F.when((F.col("kind") == "positive") & ((F.col("label") != 1) | ~F.col("one_group")), "not_positive"),
        F.when(~image & (F.col("kind") != "positive") & ((F.col("label") != 0) | F.col("one_group")), "not_negative"),
        F.when((F.col("kind") == "same_category") & ~F.col("one_category") | (F.col("kind") == "cross_category") & F.col("one_category"), "category"),
    ))
    found = rows.select("kind", "id", F.explode(bad).alias("violation")).distinct()
    groups = rows.where("kind = 'train_group' and group_id is not null").groupBy("group_id").agg(F.count_distinct("id").alias("have"))
    sizes = manifest.groupBy("group_id").agg(F.count("*").alias("n"))
    torn = groups.join(sizes, "group_id").where("have < n").select(F.lit("train_group").alias("kind"), F.col("group_id").cast("string").alias("id"), F.lit("incomplete_group").alias("violation"))
    return found.unionByName(torn)


def failure_sample(failures: DataFrame, per_category: int, seed: int = 42, fine: str = "relevant_at_top1_with_additional_top5_relevance") -> DataFrame:
    """failures: query_id, query_category, class. So many queries of each category that aren't fine; a category with
    fewer is an error, raised where the rows are read."""
    rows = failures.where(F.col("class") != fine)
    place = F.row_number().over(Window.partitionBy("query_category").orderBy(hash_int(seed, F.col("query_id")), "query_id"))
    few = rows.groupBy("query_category").agg(F.count("*").alias("n"))
    rows = rows.withColumn("place", place).where(F.col("place") <= per_category).join(F.broadcast(few), "query_category")
    checked = F.when(F.col("n") >= per_category, F.col("query_id")).otherwise(F.raise_error(F.format_string("only %d eligible queries of %s", F.col("n"), F.col("query_category"))))
    return rows.select("query_category", checked.alias("query_id"), "class", F.col("place").cast("long").alias("place"))
