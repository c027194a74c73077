"""Quality reports and the audit of a dataset: nothing here changes files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, SPLITS
from . import dedup, manifest

#: How many of the most frequent resolutions a report has, and the suffixes that source files may have.
COMMON_RESOLUTIONS = 15
SUFFIXES = (".jpg", ".jpeg")
#: Columns that a manifest must have.
REQUIRED = ("image_id", "image_path", "group_id", "category", "category_id", "split", "source")


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("double")


def _long(row: DataFrame, section: str, key: Column | None = None) -> DataFrame:
    """Columns of numbers as (section, key, metric, value) rows."""
    names = [c for c in row.columns if c != "key"]
    rows = row.select(F.coalesce(key, F.lit("")).alias("key") if key is not None else F.lit("").alias("key"), F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))))
    return rows.select(F.lit(section).alias("section"), "key", "metric", "value")


def quality_report(inspections: DataFrame) -> DataFrame:
    """inspections: image_id, split, category, status (valid, warning, invalid), readable, mode, rgb_convertible, width,
    height, reasons (array), reason. Rows (section, key, metric, value): the summary, resolutions of readable images
    and their most frequent ones, modes, reasons, and counts for each known split and category (0 where there are
    none)."""
    readable, status = F.col("readable"), F.col("status")
    abnormal = F.size("reasons") > 0
    summary = inspections.agg(
        F.count("*").alias("total_images"), _count(status == "valid").alias("valid_images"), _count(status == "warning").alias("warning_images"), _count(status == "invalid").alias("invalid_images"),
        _count(readable).alias("readable_images"), _count((status == "invalid") & (F.col("reason") == "decode_error")).alias("corrupted_images"), _count(readable & (F.col("mode") == "RGB")).alias("rgb_images"),
        _count(readable & ~(F.col("mode") == "RGB")).alias("non_rgb_images"), _count(readable & F.col("rgb_convertible")).alias("rgb_convertible_images"), _count(abnormal).alias("abnormal_images"),
    )
    out = _long(summary, "summary")
    good = inspections.where("readable")
    size = good.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("width", "height")))
    out = out.unionByName(_long(size, "resolution"))
    common = good.where("width > 0 and height > 0").groupBy("width", "height").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "width", "height").limit(COMMON_RESOLUTIONS)
    out = out.unionByName(_long(common.select(F.concat_ws("x", "width", "height").alias("key"), "count"), "common_resolutions", F.col("key")))
    out = out.unionByName(_long(good.where("mode is not null").groupBy(F.col("mode").alias("key")).agg(F.count("*").alias("count")), "color_modes", F.col("key")))
    names = inspections.sparkSession.createDataFrame([(r,) for r in ("near_black", "near_white", "near_uniform")], "key string")
    seen = inspections.select(F.explode("reasons").alias("key")).groupBy("key").agg(F.count("*").alias("count"))
    out = out.unionByName(_long(names.join(seen, "key", "left").fillna(0), "abnormal", F.col("key")))
    for column, known in (("split", SPLITS), ("category", CATEGORIES)):
        counts = inspections.groupBy(F.col(column).alias("key")).agg(
            F.count("*").alias("total"), _count(readable).alias("readable"), _count(~readable).alias("unreadable"), _count(abnormal).alias("abnormal"), *(_count(status == s).alias(s) for s in ("valid", "warning", "invalid"))
        )
        names = inspections.sparkSession.createDataFrame([(k,) for k in known], "key string")
        out = out.unionByName(_long(names.join(counts, "key", "left").fillna(0), column, F.col("key")))
    return out


def format_policy(rows: DataFrame, inspections: DataFrame | None = None) -> DataFrame:
    """suffix, files, allowed of a manifest's paths, and whether the whole complies: allowed suffixes only, and every
    readable image convertible to RGB."""
    suffix = F.lower(F.regexp_extract("image_path", r"(\.[^./]*)$", 1))
    by = rows.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files")).withColumn("allowed", F.col("suffix").isin(*SUFFIXES))
    whole = by.agg(F.coalesce(F.bool_and("allowed"), F.lit(True)).alias("suffixes_fit"))
    rgb = inspections.agg(F.coalesce(F.bool_and(~F.col("readable") | F.coalesce("rgb_convertible", F.lit(False))), F.lit(True)).alias("rgb_fits")) if inspections is not None else whole.select(F.lit(True).alias("rgb_fits"))
    fits = whole.crossJoin(rgb).select((F.col("suffixes_fit") & F.col("rgb_fits")).alias("compliant"))
    return by.crossJoin(fits)


def metadata_policy(rows: DataFrame) -> DataFrame:
    """field, present, rows, filled of each required column: whether there is such a column, and how many rows have a value
    in it that isn't blank."""
    filled = [F.count(F.when(F.trim(F.col(f).cast("string")) != "", 1)) if f in rows.columns else F.lit(0).cast("long") for f in REQUIRED]
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(f in rows.columns).alias("present"), F.col("n").alias("rows"), F.col(f"_{f}").alias("filled")) for f in REQUIRED))
    return rows.agg(F.count("*").alias("n"), *(c.alias(f"_{f}") for f, c in zip(REQUIRED, filled))).select(F.inline(fields))


#: Requirements of the audit: name, part, and the finding that must be 0.
REQUIREMENTS = (
    ("row_contract", "manifest", "row_violations"),
    ("one_split_for_a_group", "groups", "cross_split_groups"),
    ("no_missing_files", "filesystem", "missing_files"),
    ("no_orphan_files", "filesystem", "orphan_files"),
    ("no_unexpected_paths", "filesystem", "unexpected_paths"),
    ("no_corrupted_images", "quality", "corrupted"),
    ("no_invalid_images", "quality", "invalid"),
    ("no_exact_duplicates", "duplicates", "exact_groups"),
    ("no_perceptual_duplicates", "duplicates", "perceptual_groups"),
    ("source_formats", "format", "foreign_suffixes"),
    ("rgb_convertible", "format", "not_convertible"),
    ("required_fields", "metadata", "missing_fields"),
)


def findings(rows: DataFrame, listing: DataFrame | None = None, inspections: DataFrame | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """(finding, found) of every part that there is input for: one number each."""
    one = lambda df, name: df.agg(F.count("*").alias("found")).select(F.lit(name).alias("finding"), "found")
    parts = [one(manifest.row_violations(rows), "row_violations"), one(manifest.split_leaks(rows), "cross_split_groups"), one(format_policy(rows).where("not allowed"), "foreign_suffixes"), one(metadata_policy(rows).where("not present"), "missing_fields")]
    if listing is not None:
        lost = manifest.orphans(rows, listing)
        relative = listing.select(F.regexp_replace("image_path", "^[^/]*/", "").alias("relative_path"))
        parts += [one(lost.where("kind = 'missing_file'"), "missing_files"), one(lost.where("kind = 'orphan_file'"), "orphan_files"), one(manifest.unexpected_paths(relative), "unexpected_paths")]
    if inspections is not None:
        parts += [one(inspections.where("reason = 'decode_error'"), "corrupted"), one(inspections.where("status = 'invalid'"), "invalid"), one(inspections.where("readable and not rgb_convertible"), "not_convertible")]
    if fingerprints is not None:
        parts += [one(dedup.exact_classes(fingerprints), "exact_groups"), one(dedup.perceptual_classes(fingerprints), "perceptual_groups")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cleaning_audit(rows: DataFrame, listing: DataFrame | None = None, inspections: DataFrame | None = None, fingerprints: DataFrame | None = None, mode: str = "audit") -> DataFrame:
    """requirement, part, found, status of each requirement: PASS, FAIL, or NOT_AVAILABLE for parts without input. It
    only looks: any other mode is an error."""
    if mode != "audit":
        raise ValueError(f"only the mode 'audit' exists, not {mode!r}")
    rules = rows.sparkSession.createDataFrame(list(REQUIREMENTS), "requirement string, part string, finding string")
    found = rules.join(F.broadcast(findings(rows, listing, inspections, fingerprints)), "finding", "left")
    status = F.when(F.col("found").isNull(), "NOT_AVAILABLE").when(F.col("found") == 0, "PASS").otherwise("FAIL")
    return found.select("requirement", "part", "found", status.alias("status"))


def overall(audit: DataFrame) -> DataFrame:
    """status: PASS if no requirement fails, and how many do."""
    failed = F.sum((F.col("status") == "FAIL").cast("long"))
    return audit.agg(F.when(failed == 0, "PASS").otherwise("FAIL").alias("status"), failed.alias("failed"))


def protocol_violations(evaluations: DataFrame) -> DataFrame:
    """evaluations: query_split, gallery_split: those in which the two differ. No group is in two splits, so a query can
    find its product in its own split alone."""
    return evaluations.where(~F.col("query_split").eqNullSafe(F.col("gallery_split")))


def metric_violations(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of numbers that are missing, not finite, or outside 0 to 1."""
    names = [c for c in metrics.columns if c not in keys]
    rows = metrics.unpivot(keys, names, "metric", "value")
    v = F.col("value")
    return rows.where(v.isNull() | F.isnan(v) | (v < 0) | (v > 1))


def assert_none(violations: DataFrame, what: str) -> None:
    bad = violations.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")
