"""Manifest contracts, profiles and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, SPLITS
from .order import numbered


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def row_violations(manifest: DataFrame, source: str = "dataset1") -> DataFrame:
    """Rows that break the contract, with the rules that they break."""
    known = F.array(*map(F.lit, CATEGORIES))
    rules = {
        "blank_image_id": blank("image_id"),
        "blank_image_path": blank("image_path"),
        "blank_group_id": blank("group_id"),
        "unknown_category": ~F.coalesce(F.array_contains(known, F.col("category")), F.lit(False)),
        "category_id": F.coalesce((F.array_position(known, F.col("category")) - 1) != F.col("category_id"), F.lit(True)),
        "unknown_split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "unknown_source": ~F.coalesce(F.col("source") == source, F.lit(False)),
    }
    rows = manifest.withColumn("repeats", F.count("*").over(Window.partitionBy("image_id")))
    bad = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()), F.when(F.col("repeats") > 1, "repeated_image_id")))
    return rows.withColumn("violations", bad).where(F.size("violations") > 0).select("image_id", F.array_join("violations", ",").alias("violations"))


def split_leaks(manifest: DataFrame) -> DataFrame:
    """Groups in more than one split."""
    rows = manifest.groupBy("group_id").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return rows.where(F.size("s") > 1).select("group_id", F.array_join("s", ",").alias("splits"))


def check(manifest: DataFrame, mode: str = "fail") -> DataFrame:
    """All violations as (rule, rows). fail raises if there are any; report returns them."""
    rows = row_violations(manifest).select(F.explode(F.split("violations", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
    leaks = split_leaks(manifest).agg(F.count("*").alias("rows")).where("rows > 0").select(F.lit("group_in_splits").alias("rule"), "rows")
    found = rows.unionByName(leaks)
    if mode == "fail" and (bad := found.collect()):
        raise ValueError(f"the manifest breaks rules: {sorted((r.rule, r.rows) for r in bad)}")
    return found


def profile(manifest: DataFrame) -> DataFrame:
    """Images and groups over all, by split, by category and by both: one pass over grouping sets."""
    s, c = F.col("split"), F.col("category")
    return manifest.groupingSets([[], [s], [c], [s, c]], s, c).agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"))


def contract_mismatches(manifest: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Totals that differ from the expected ones."""
    actual = manifest.agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"), *(F.sum((F.col("split") == s).cast("long")).alias(s) for s in SPLITS))
    names = ["images", "groups", *SPLITS]
    rows = actual.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("actual")) for n in names))))
    want = manifest.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return want.join(rows, "name", "left").where(~F.col("actual").eqNullSafe(F.col("expected")))


def group_sizes(manifest: DataFrame) -> DataFrame:
    """Groups by size: 1, 2, 3, 4+."""
    n = manifest.groupBy("group_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 4, "4+").otherwise(F.col("n").cast("string")).alias("size")).agg(F.count("*").alias("groups"), F.sum("n").alias("images"))


def orphans(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of the manifest without a file, and files without a row."""
    gone = manifest.select("image_path").join(listing.select("image_path"), "image_path", "left_anti").withColumn("kind", F.lit("missing_file"))
    extra = listing.select("image_path").join(manifest.select("image_path"), "image_path", "left_anti").withColumn("kind", F.lit("orphan_file"))
    return gone.unionByName(extra)


def paths(relative: Column, root: str) -> Column:
    return F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), relative))


def _placed(listing: DataFrame) -> DataFrame:
    p = F.split("relative_path", "/")
    known, splits = F.array(*map(F.lit, CATEGORIES)), F.array(*map(F.lit, SPLITS))
    rows = listing.select("relative_path", p[0].alias("split"), p[1].alias("category"), F.size(p).alias("depth"))
    rows = rows.withColumn("category_id", (F.array_position(known, F.col("category")) - 1).cast("long")).withColumn("s", F.array_position(splits, F.col("split")))
    return rows.withColumn("fits", F.coalesce((F.col("depth") == 3) & (F.col("category_id") >= 0) & (F.col("s") > 0), F.lit(False)))


def from_listing(listing: DataFrame) -> DataFrame:
    """A manifest of files split/category/name: ids in order of split, category and path. Other files are those of
    unexpected_paths()."""
    rows = numbered(_placed(listing).where("fits"), [F.col("s"), F.col("category"), F.col("relative_path")], "place")
    return rows.select(F.format_string("DS1_IMG_%06d", F.col("place") + 1).alias("image_id"), F.col("relative_path").alias("image_path"), "category", "category_id", "split")


def unexpected_paths(listing: DataFrame) -> DataFrame:
    """Files that don't stand at split/category/name, with the reason."""
    reason = F.when(F.col("depth") != 3, "depth").when(F.coalesce(F.col("s"), F.lit(0)) == 0, "split").otherwise("category")
    return _placed(listing).where("not fits").select("relative_path", reason.alias("reason"))


def listing_counts(listing: DataFrame) -> DataFrame:
    """Files by split and category, over each and over all, of those that stand where they belong."""
    s, c = F.col("split"), F.col("category")
    return _placed(listing).where("fits").groupingSets([[], [s], [s, c]], s, c).agg(F.count("*").alias("files"))


def of_split(manifest: DataFrame, split: str, category: str | None = None) -> DataFrame:
    """The rows of a split (and category); none is an error."""
    if split not in SPLITS or category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown split or category: {split}, {category}")
    rows = manifest.where(F.col("split") == split)
    rows = rows if category is None else rows.where(F.col("category") == category)
    if rows.isEmpty():
        raise ValueError(f"the manifest has no rows of {split}" + (f", {category}" if category else ""))
    return rows


def gallery_violations(gallery: DataFrame, dimension: int, tolerance: float = 1e-3) -> DataFrame:
    """Rows that can't be served: blank or repeated ids, wrong dimension, values that aren't finite, norms off 1."""
    from ..functions.vectors import is_finite, norm

    rows = gallery.withColumn("repeats", F.count("*").over(Window.partitionBy("image_id")))
    bad = F.array_compact(F.array(
        F.when(blank("image_id"), "blank_image_id"),
        F.when(blank("product_id"), "blank_product_id"),
        F.when(F.col("repeats") > 1, "repeated_image_id"),
        F.when(F.coalesce(F.size("embedding") != dimension, F.lit(True)), "dimension"),
        F.when(~F.coalesce(is_finite("embedding"), F.lit(False)), "not_finite"),
        F.when(F.abs(norm("embedding") - 1) > tolerance, "norm"),
    ))
    return rows.withColumn("violations", bad).where(F.size("violations") > 0).select("image_id", F.array_join("violations", ",").alias("violations"))


def norm_stats(gallery: DataFrame) -> DataFrame:
    from ..functions.vectors import norm

    n = norm("embedding")
    return gallery.agg(F.count("*").alias("images"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.round(F.min(n), 6).alias("low"), F.round(F.max(n), 6).alias("high"))


def canonical_metadata(rows: DataFrame) -> DataFrame:
    """Older field names (product_group, image_path) under today's (product_id, image)."""
    have = set(rows.columns)
    pick = lambda new, old: F.coalesce(*(F.col(c) for c in (new, old) if c in have)).alias(new)
    rest = [c for c in rows.columns if c not in ("product_id", "product_group", "image", "image_path")]
    return rows.select(*rest, pick("product_id", "product_group"), pick("image", "image_path"))


#: Requirements of an audit: name, the finding it reads, and the most that it may count.
REQUIREMENTS = (("unique_image_ids", "repeated_image_id", 0), ("known_categories", "unknown_category", 0), ("category_ids", "category_id", 0), ("one_split_for_a_group", "group_in_splits", 0), ("no_missing_files", "missing_file", 0), ("no_orphan_files", "orphan_file", 0))


def audit(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """requirement, found, status: PASS or FAIL by the rule table."""
    found = check(manifest, "report").unionByName(orphans(manifest, listing).groupBy(F.col("kind").alias("rule")).agg(F.count("*").alias("rows")))
    rules = manifest.sparkSession.createDataFrame(list(REQUIREMENTS), "requirement string, rule string, most int")
    rows = rules.join(found, "rule", "left").withColumn("found", F.coalesce("rows", F.lit(0)))
    return rows.select("requirement", "found", F.when(F.col("found") <= F.col("most"), "PASS").otherwise("FAIL").alias("status"))
