"""Exact, perceptual and near duplicates of fingerprinted files.

Equal contents and equal fingerprints are classes: one row each, with a membership table beside them. Near duplicates
are links of fingerprint classes. At a distance of at most t, of t + s bands of the 64 bits at least s are equal, so an
equi-join on every s bands together finds every link: the keys get longer with s, and s follows the number of classes,
so a key's bucket holds few of them whatever their number. Pairs of files are only written out where they are asked for.

Groups and pairs are those within a dataset; what both datasets share is told apart (cross_groups, across=True).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import BITS
from .order import numbered, settled
from .selection import first_n


def band_layout(threshold: int, bits: int = BITS, equal: int = 1) -> list[tuple[int, int]]:
    """(shift, width) of threshold + equal bands from the high bits down; the first ones take what doesn't divide."""
    n = threshold + equal
    base, more = divmod(bits, n)
    out, at = [], bits
    for k in range(n):
        width = base + (k < more)
        at -= width
        out.append((at, width))
    return out


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _members() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("members")


def exact_classes(rows: DataFrame) -> DataFrame:
    """Contents of more than one file of a dataset, with their number of files."""
    return rows.groupBy("dataset", "exact_hash").agg(F.count("*").alias("files")).where("files > 1")


def exact_membership(rows: DataFrame) -> DataFrame:
    """doc_id, dataset, exact_hash, files, keep_id of each file: its content's files in its dataset and the smallest doc_id
    of them."""
    classes = rows.groupBy("dataset", "exact_hash").agg(F.count("*").alias("files"), F.min("doc_id").alias("keep_id"))
    return rows.select("doc_id", "dataset", "exact_hash").join(classes, ["dataset", "exact_hash"]).select("doc_id", "dataset", "exact_hash", "files", "keep_id")


def exact_groups(rows: DataFrame) -> DataFrame:
    """exact_classes() with a list of members, for a report: a row is as long as its group."""
    return rows.groupBy("dataset", "exact_hash").agg(F.count("*").alias("files"), _members()).where("files > 1")


def _perceptual(rows: DataFrame, *more: Column) -> DataFrame:
    found = rows.groupBy("dataset", "fp").agg(F.first("bits").alias("bits"), F.count("*").alias("files"), F.count_distinct("exact_hash").alias("contents"), *more)
    return found.where("files > 1 and contents > 1")


def perceptual_classes(rows: DataFrame) -> DataFrame:
    """Fingerprints of more than one content in a dataset."""
    return _perceptual(rows)


def perceptual_groups(rows: DataFrame) -> DataFrame:
    """perceptual_classes() with a list of members, for a report."""
    return _perceptual(rows, _members()).drop("fp")


def cross_groups(rows: DataFrame, key: str) -> DataFrame:
    """Values of key that both datasets have."""
    found = rows.groupBy(key).agg(F.count_distinct("dataset").alias("d"), F.sum((F.col("dataset") == "a").cast("long")).alias("in_a"), F.sum((F.col("dataset") == "b").cast("long")).alias("in_b"))
    return found.where("d = 2").drop("d")


def _banded(rows: DataFrame, threshold: int) -> DataFrame:
    """rows with band and value, a row for each of their threshold + 1 bands."""
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (at, width) in enumerate(band_layout(threshold))))
    return rows.select(*rows.columns, F.inline(bands))


def candidate_count(rows: DataFrame, threshold: int) -> DataFrame:
    """How many pairs of files of one dataset share a band, counted by classes: pairs are written out for neither
    copies nor files."""
    classes = settled(rows.groupBy("dataset", "fp").agg(F.count("*").alias("files")))
    one, two = (_banded(classes, threshold).select("dataset", "band", "value", *(F.col(c).alias(f"{c}_{k}") for c in ("fp", "files"))) for k in (1, 2))
    pairs = one.hint("merge").join(two, ["dataset", "band", "value"]).where("fp_1 < fp_2")
    # A pair counts under the first band that it shares.
    x = F.col("fp_1").bitwiseXOR(F.col("fp_2"))
    same = F.coalesce(*(F.when(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1)) == 0, F.lit(k)) for k, (at, width) in enumerate(band_layout(threshold))))
    across = pairs.where(same == F.col("band")).agg(F.coalesce(F.sum(F.col("files_1") * F.col("files_2")), F.lit(0)).alias("n"))
    within = classes.agg(F.coalesce(F.sum(F.expr("files * (files - 1) div 2")), F.lit(0)).alias("n"))
    return across.unionByName(within).agg(F.sum("n").alias("candidates"))


def candidates(rows: DataFrame, threshold: int, most: int) -> DataFrame:
    """For each file its first `most` later files of the same dataset that share a band, with their distance and place. In
    a band's bucket no more than the next `most` files can be among them, so files meet by their places in it, and a bucket
    of any size costs its files times `most`."""
    ids = rows.select("doc_id", "dataset", "exact_hash", "fp")
    order = ["dataset", "band", "value", "doc_id"]
    placed = settled(numbered(_banded(ids, threshold), [F.col(c) for c in order], "place"))
    one, two = (placed.select(F.col("place").alias(f"place_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "dataset", "band", "value", "exact_hash", "fp"))) for k in (1, 2))
    later = one.withColumn("place_2", F.explode(F.sequence(F.col("place_1") + 1, F.col("place_1") + most)))
    met = later.hint("merge").join(two, "place_2").where(" and ".join(f"{c}_1 = {c}_2" for c in order[:3]))
    pairs = met.select("doc_id_1", "doc_id_2", "exact_hash_1", "exact_hash_2", hamming("fp_1", "fp_2").cast("long").alias("distance")).distinct()
    # At most `most` rows for each band of a file.
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("doc_id_1").orderBy("doc_id_2"))).where(F.col("place") <= most)


def near_classes(rows: DataFrame, threshold: int = 5, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Links (fp_1, fp_2, distance, and files_1, files_2 and keys of both sides) of fingerprints at distance 1 to
    threshold, fp_1 before fp_2, and the classes (fp, keys, files). A file belongs to the class of its fp."""
    # Read by the count, both sides of the join and both sides of the result.
    classes = settled(rows.groupBy("fp", *keys).agg(F.count("*").alias("files")))
    points = classes.select("fp").distinct()
    n = points.count()
    equal = next((s for s in (1, 2, 3) if s * BITS // (threshold + s) >= max(1, n).bit_length()), 4)
    bands = band_layout(threshold, BITS, equal)
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in bands]
    sets = list(combinations(range(len(bands)), equal))
    packed = []
    for k, chosen in enumerate(sets):
        value = F.lit(0).cast("long")
        for i in chosen:
            value = F.shiftleft(value, bands[i][1]).bitwiseOR(part[i])
        packed.append(F.struct(F.lit(k).alias("k"), value.alias("value")))
    spread = points.select("fp", F.inline(F.array(*packed)))
    one, two = spread.withColumnRenamed("fp", "fp_1"), spread.withColumnRenamed("fp", "fp_2")
    # A size estimated for the points doesn't count their rows for each set: without the hint they may be broadcast, and the
    # driver would hold them all.
    pairs = one.hint("merge").join(two, ["k", "value"]).where((F.col("fp_1") < F.col("fp_2")) & hamming("fp_1", "fp_2").between(1, threshold))
    # A pair counts under the first of its sets of equal bands.
    x = F.col("fp_1").bitwiseXOR(F.col("fp_2"))
    same = F.array_compact(F.array(*(F.when(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1)) == 0, F.lit(i)) for i, (at, width) in enumerate(bands))))
    names = F.array(*(F.array(*map(F.lit, chosen)) for chosen in sets))
    pairs = pairs.where(F.slice(same, 1, equal) == F.element_at(names, F.col("k") + 1)).select("fp_1", "fp_2", hamming("fp_1", "fp_2").cast("long").alias("distance"))
    for side in (1, 2):
        pairs = pairs.join(classes.select(F.col("fp").alias(f"fp_{side}"), F.col("files").alias(f"files_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in keys)), f"fp_{side}")
    return pairs, classes


def near_pairs(rows: DataFrame, threshold: int = 5, across: bool = False) -> DataFrame:
    """Pairs of files at distance 1 to threshold, doc_id_1 before doc_id_2, of one dataset or across both, written out from
    the links of their classes. Other fingerprints mean other contents."""
    keys = ("fp", "dataset")
    rows = settled(rows.select("doc_id", *keys))
    links = near_links(rows, threshold, across)
    out = links.select("distance", *(f"{k}_{side}" for k in keys for side in (1, 2)))
    for side in (1, 2):
        out = out.join(rows.select(F.col("doc_id").alias(f"d{side}"), *(F.col(k).alias(f"{k}_{side}") for k in keys)), [f"{k}_{side}" for k in keys])
    return out.select(F.least("d1", "d2").alias("doc_id_1"), F.greatest("d1", "d2").alias("doc_id_2"), "distance")


def near_links(rows: DataFrame, threshold: int = 5, across: bool = False) -> DataFrame:
    """near_classes() by dataset: the links within each dataset, or those across both."""
    links, _ = near_classes(rows, threshold, ("dataset",))
    return links.where("dataset_1 <> dataset_2" if across else "dataset_1 = dataset_2")


def limited_pairs(rows: DataFrame, threshold: int = 5, max_candidates: int | None = None, max_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """near_pairs() under limits, and what they left out: each file keeps its first max_candidates later files of its
    dataset that share a band, and of these pairs in order (doc_id_1, doc_id_2) the first max_pairs are compared. The
    status is partial if any is left out. Without max_candidates a file keeps as many as there are files."""
    rows = settled(rows.select("doc_id", "dataset", "exact_hash", "fp"))
    kept = settled(candidates(rows, threshold, max_candidates if max_candidates is not None else max(1, rows.count() - 1)))
    if max_pairs is not None:
        kept = first_n(kept, F.col("doc_id_1"), max_pairs, [F.col("doc_id_2")])
    stats = candidate_count(rows, threshold).crossJoin(kept.agg(F.count("*").alias("compared")))
    stats = stats.select("candidates", "compared", (F.col("candidates") - F.col("compared")).alias("skipped"), F.when(F.col("candidates") > F.col("compared"), "partial").otherwise("complete").alias("status"))
    near = kept.where(F.col("distance").between(1, threshold) & (F.col("exact_hash_1") != F.col("exact_hash_2")))
    return near.select("doc_id_1", "doc_id_2", "distance"), stats


def near_stats(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """How many pairs of files of one dataset stand at each distance, counted from the classes."""
    return near_links(rows, threshold).groupBy("distance").agg(F.sum(F.col("files_1") * F.col("files_2")).alias("pairs"))


def summary(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """The duplicate report in one row: files of each dataset, those without a fingerprint, groups and near pairs within
    the datasets, and what both datasets share, by content, fingerprint and nearness. The fingerprints are made once."""
    rows = settled(rows)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    out = rows.agg(F.count("*").alias("files"), *(one(F.col("dataset") == x, f"files_{x}") for x in "ab"), one(F.col("fp").isNull(), "unreadable"))
    readable = rows.where("fp is not null")
    links, _ = near_classes(readable, threshold, ("dataset",))
    pairs = F.col("files_1") * F.col("files_2")
    near = links.agg(*(F.coalesce(F.sum(F.when(F.expr(f"dataset_1 {op} dataset_2"), pairs)), F.lit(0)).alias(name) for op, name in (("=", "near_pairs"), ("<>", "cross_near_pairs"))))
    parts = [count(exact_classes(rows), "exact_groups"), count(perceptual_classes(readable), "perceptual_groups"), near, count(cross_groups(rows, "exact_hash"), "cross_exact_groups"), count(cross_groups(readable, "fp"), "cross_perceptual_groups")]
    for part in parts:
        out = out.crossJoin(part)
    return out
