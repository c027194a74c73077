"""Queries on files, pictures' positions and encoders over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import G, IMAGES, MANIFEST, _gallery, _images, _manifest, query
from .catalog import ANNOTATIONS, POSITIVES, _annotations
from .operators import analysis, containers, encoders, evaluation, images, order, pairs, search
from .sources import adapters, io

# --- files ------------------------------------------------------------------------------------------------------------
#: The head of a file for each document: the format by doc_id, the sides from its lengths.
SIDES = "1 + n_chars % 4000 AS w, 1 + doc_id % 3000 AS h"
KINDS = ("JPEG", "PNG", "GIF", "BMP", "WEBP", "TIFF", None)
CHANNELS = (3, 4, 1, 3, 4, 1, None)
SUFFIX = (".jpg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".jpg")


def _headers(spark, d) -> DataFrame:
    """doc_id, path, content: every fifth file has the suffix of the next format."""
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c, n: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(big(c, n), 2 * k + 1, F.lit(2)))), "")
    w, h = (1 + F.col("n_chars") % 4000).cast("long"), (1 + F.col("doc_id") % 3000).cast("long")
    # A comment of any length comes before a JPEG's frame.
    comment = (F.col("n_chars") % 50).cast("int")
    heads = (
        F.concat(F.lit("FFD8FFFE"), big((comment + 2).cast("long"), 2), F.repeat(F.lit("20"), comment), F.lit("FFC2001108"), big(h, 2), big(w, 2), F.lit("03")),
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806000000")),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("F70000")),
        F.concat(F.lit("424D"), F.repeat(F.lit("00"), 12), F.lit("28000000"), little(w, 4), little(h, 4), F.lit("01001800")),
        F.concat(F.lit("52494646000000005745425056503858"), F.lit("0A00000010000000"), little(w - 1, 3), little(h - 1, 3)),
        F.concat(F.lit("49492A00080000000300"), F.lit("0001040001000000"), little(w, 4), F.lit("0101040001000000"), little(h, 4), F.lit("1501030001000000"), F.lit("01000000")),
        F.hex(F.encode(F.substring("text", 1, 12), "utf-8")),
    )
    kind = (F.col("doc_id") % len(heads)).cast("int")
    of = lambda values, k: F.element_at(F.array(*values), k + 1)
    suffix = of([F.lit(s) for s in SUFFIX], F.when(F.col("doc_id") % 5 == 0, (kind + 1) % len(heads)).otherwise(kind))
    rows = adapters.read(spark, d, "documents")
    return rows.select("doc_id", F.concat(F.lit("files/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.unhex(of(heads, kind)).alias("content"))


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


FILES = f"""f AS (SELECT doc_id, {SIDES}, doc_id % 7 AS k, {_listed(KINDS)}[doc_id % 7 + 1] AS format, {_listed(CHANNELS)}[doc_id % 7 + 1] AS channels,
    {_listed(SUFFIX)}[CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7 + 1) % 7 ELSE doc_id % 7 END + 1] AS suffix FROM documents)"""


@query(f"WITH {FILES} SELECT doc_id, format, CASE WHEN k < 6 THEN CAST(w AS BIGINT) END AS width, CASE WHEN k < 6 THEN CAST(h AS BIGINT) END AS height, CAST(channels AS BIGINT) AS channels FROM f")
def container_headers(spark, d):
    return containers.containers(_headers(spark, d), "doc_id").select("doc_id", "format", "width", "height", F.col("channels").cast("long").alias("channels"))


@query(f"""WITH {FILES} SELECT suffix, format, count(*) AS files, count(*) FILTER (format = 'JPEG') AS allowed,
           count(*) FILTER (coalesce(list_contains(CASE format WHEN 'JPEG' THEN ['.jpg', '.jpeg'] WHEN 'PNG' THEN ['.png'] WHEN 'GIF' THEN ['.gif'] WHEN 'WEBP' THEN ['.webp'] WHEN 'BMP' THEN ['.bmp'] WHEN 'TIFF' THEN ['.tif', '.tiff'] END, suffix), false)) AS fitting
           FROM f GROUP BY 1, 2""")
def format_disagreements(spark, d):
    """Suffixes against formats: every fifth file has another format's suffix, and every seventh is no picture."""
    rows = containers.with_verdict(containers.containers(_headers(spark, d)), "path")
    n = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy("suffix", "format").agg(F.count("*").alias("files"), n("allowed").alias("allowed"), n("suffix_fits").alias("fitting"))


# --- products from hits, and their pictures ---------------------------------------------------------------------------------
@query(f"""WITH {IMAGES}, h AS (SELECT query_id, product_id, max(sim) AS s, arg_min(category, rank) AS category, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY rank) AS matched, string_agg('p/' || image_id || '.png', ',' ORDER BY rank) AS paths FROM i WHERE rank <= 10 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, product_id) AS rank FROM h) SELECT query_id, product_id, category, rank, matched, paths FROM r WHERE rank <= 5""")
def products_with_paths(spark, d):
    names = _gallery(spark, d).select("image_id", "category", F.concat(F.lit("p/"), F.col("image_id").cast("string"), F.lit(".png")).alias("image_path"))
    rows = search.pool_hits(_images(spark, d).join(names, "image_id"), 5)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("query_id", "product_id", "category", F.col("rank").cast("long").alias("rank"), joined("matched_image_ids").alias("matched"), joined("matched_image_paths").alias("paths"))


@query(f"""WITH {MANIFEST}, c AS (SELECT image_id, group_id AS product_id, 'images/' || image_id || CASE image_id % 4 WHEN 0 THEN '.BMP' WHEN 1 THEN '.JPG' ELSE '.webp' END AS image_path FROM mf)
    SELECT product_id, arg_min(image_path, image_id) AS image_path FROM c WHERE image_id % 4 <> 0 AND image_id % 3 <> 1 GROUP BY 1""")
def product_images(spark, d):
    """Of each product every fourth picture has a suffix that isn't shown, and every third file is gone."""
    i = F.col("image_id")
    path = F.concat(F.lit("images/"), i.cast("string"), F.when(i % 4 == 0, ".BMP").when(i % 4 == 1, ".JPG").otherwise(".webp"))
    rows = _manifest(spark, d).select("image_id", F.col("group_id").alias("product_id"), path.alias("image_path"))
    return search.product_images(rows, rows.where("image_id % 3 <> 1").select(F.col("image_path").alias("path")))


# --- positions and encoders ---------------------------------------------------------------------------------------------------
STABLE = f"""{G}, tr AS (SELECT 'original' AS variant, image_id, v AS t FROM g
        UNION ALL SELECT 'flip', image_id, list_transform(v, lambda x, i: CASE WHEN i <= 8 THEN -x ELSE x END) FROM g UNION ALL SELECT 'shift', image_id, list_transform(v, lambda x: x + 0.05::DOUBLE) FROM g),
    pp AS (SELECT variant, tr.image_id AS query_id, g.product_id, any_value(category) AS category, max(list_cosine_similarity(t, v)) AS sim FROM tr, g GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY sim DESC, product_id) AS rank FROM pp QUALIFY rank <= 5),
    b AS (SELECT query_id, product_id, rank AS b_rank FROM rk WHERE variant = 'original'),
    f AS (SELECT query_id, product_id AS first_product, category AS first_category FROM rk WHERE variant = 'original' AND rank = 1),
    sb AS (SELECT variant, rk.query_id, count(b_rank) AS shared, max(CAST(rank = 1 AND rk.product_id = first_product AS DOUBLE)) AS same_first, avg(abs(rank - b_rank)) AS moved, max(CAST(rank = 1 AND category = first_category AS DOUBLE)) AS passed
           FROM rk JOIN f ON f.query_id = rk.query_id LEFT JOIN b ON b.query_id = rk.query_id AND b.product_id = rk.product_id GROUP BY 1, 2)"""


@query(f"WITH {STABLE} SELECT variant, count(*) AS queries, round(avg(shared / 5.0::DOUBLE), 6) AS overlap, round(avg(same_first), 6) AS same_first, round(avg(moved), 6) AS moved, round(avg(passed), 6) AS passed FROM sb GROUP BY 1")
def rank_stability(spark, d):
    """Each image's first five products against those of its disturbed forms: one search for all."""
    g = _gallery(spark, d)
    kinds = ("original", "flip", "shift")
    forms = F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(n).alias("n"), (F.col("embedding").cast("array<double>") if k == "original" else evaluation.transformed("embedding", k)).alias("e")) for n, k in enumerate(kinds)))
    asked = g.select(F.col("image_id").alias("own"), F.inline(forms)).select((F.col("own") * len(kinds) + F.col("n")).alias("query_id"), "own", "variant", F.col("e").alias("embedding"))
    hits = search.top_products(asked.select("query_id", "embedding"), g, 5, False)
    names = g.groupBy("product_id").agg(F.first("category").alias("category"))
    ranked = hits.join(asked.select("query_id", "own", "variant"), "query_id").join(names, "product_id").select(F.col("own").alias("query_id"), "variant", "product_id", "category", "rank")
    return analysis.stability_report(analysis.rank_stability(ranked, "original"))


#: A head of 8 rows whose weights follow from their places.
HEAD, INPUTS = 8, 64


def _head(spark) -> encoders.ShippedHead:
    i, j = np.mgrid[0:HEAD, 0:INPUTS]
    return encoders.ShippedHead(spark, ((7 * i + 3 * j) % 11 - 5) / 10, (np.arange(HEAD) % 3 - 1) / 10)


PROJECTED = f"""{G}, y AS (SELECT image_id, list_transform(range({HEAD}), lambda r: list_sum(list_transform(v, lambda x, k: x * (((7 * r + 3 * (k - 1)) % 11 - 5) / 10.0::DOUBLE))) + (r % 3 - 1) / 10.0::DOUBLE) AS y FROM g),
    pr AS (SELECT image_id, list_transform(y, lambda a: a / sqrt(list_sum(list_transform(y, lambda b: b * b)))) AS e FROM y)"""


@query(f"WITH {PROJECTED} SELECT image_id, " + ", ".join(f"round(e[{k + 1}], 6) AS e{k}" for k in range(HEAD)) + " FROM pr")
def head_embeddings(spark, d):
    """The gallery through a linear head that the workers open from a shipped file."""
    rows = _head(spark).vectors(_gallery(spark, d), "image_id")
    return rows.select("image_id", *(F.round(F.col("embedding")[k], 6).alias(f"e{k}") for k in range(HEAD)))


@query(f"""WITH {PROJECTED}, s AS (SELECT a.image_id AS query_id, b.image_id, list_cosine_similarity(a.e, b.e) AS sim FROM pr a JOIN pr b ON a.image_id <> b.image_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, image_id) AS rank FROM s) SELECT query_id, image_id, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 3""")
def head_search(spark, d):
    """Encode and search in one plan."""
    g = _gallery(spark, d)
    encoded = _head(spark).vectors(g, "image_id").join(g.select("image_id", "product_id"), "image_id")
    hits = search.top_images(search.as_queries(encoded), encoded, 3)
    return hits.select("query_id", "image_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


# --- writers and readers ------------------------------------------------------------------------------------------------------
def _folder(spark) -> str:
    return f"{order.shared_folder(spark)}/lumenlake-{uuid.uuid4().hex}"


def _back(spark, path: str, rows: DataFrame) -> DataFrame:
    """What was read from a folder, without the folder: as Parquet, which takes a fraction of a checkpoint's bytes."""
    kept = _folder(spark)
    rows.write.parquet(kept)
    io.delete(spark, path)
    return spark.read.schema(rows.schema).parquet(kept)


def _written(rows: DataFrame) -> str:
    path = _folder(rows.sparkSession)
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


NOTE = "'a \"note\",' || chr(10) || image_id"


def _noted(spark, d) -> DataFrame:
    """The manifest as it stands in files, with a column of notes with quotes and line breaks; every third is empty."""
    i = F.col("image_id")
    note = F.when(i % 3 != 0, F.concat(F.lit('a "note",\n'), i.cast("string")))
    return _manifest(spark, d).select(i.cast("string").alias("image_id"), "image_path", F.col("group_id").cast("string").alias("group_id"), "category", "category_id", "split", F.lit("dataset1").alias("source"), note.alias("note"))


@query(f"WITH {MANIFEST} SELECT CAST(image_id AS VARCHAR) AS image_id, '/data/' || image_path AS image_path, CAST(group_id AS VARCHAR) AS group_id, category, CAST(category_id AS BIGINT) AS category_id, split, CASE WHEN image_id % 3 <> 0 THEN {NOTE} END AS note FROM mf")
def manifest_files(spark, d):
    """The manifest written as CSV files and read again."""
    path = _written(_noted(spark, d))
    rows = _back(spark, path, io.read_manifest(spark, path, "/data"))
    return rows.select("image_id", "image_path", "group_id", "category", F.col("category_id").cast("long").alias("category_id"), "split", F.col("metadata")["note"].alias("note"))


@query(f"WITH {MANIFEST} SELECT CAST(image_id AS VARCHAR) AS image_id, category, split FROM mf")
def evaluation_manifest_files(spark, d):
    path = _written(_noted(spark, d).drop("source", "category_id"))
    rows = _back(spark, path, io.read_evaluation_manifest(spark, path))
    return rows.select("image_id", "category", "split")


@query(f"WITH {POSITIVES} SELECT pair_id, CAST(image_id_1 AS VARCHAR) AS image_id_1, CAST(image_id_2 AS VARCHAR) AS image_id_2, split, CAST(label AS BIGINT) AS label, CASE WHEN image_id_1 % 2 = 0 THEN 'random' END AS negative_type FROM pos")
def pair_files(spark, d):
    """Pairs written and read: a null type is an empty field in the file and null again behind it."""
    m = _manifest(spark, d)
    ids = m.groupBy("category").agg(F.min("category_id").cast("int").alias("category_id"))
    rows = pairs.positives(m).withColumn("negative_type", F.when(F.col("image_id_1") % 2 == 0, "random"))
    for k in (1, 2):
        rows = rows.join(ids.select(F.col("category").alias(f"category_{k}"), F.col("category_id").alias(f"category_id_{k}")), f"category_{k}")
    path = _folder(spark)
    io.write_pairs(rows, path)
    return _back(spark, path, io.read_pairs(spark, path)).select("pair_id", "image_id_1", "image_id_2", "split", F.col("label").cast("long").alias("label"), "negative_type")


@query(f"WITH {ANNOTATIONS} SELECT query_id || '-' || rank AS annotation_id, CAST(rank AS BIGINT) AS rank, CAST(relevance AS BIGINT) AS relevance, candidate_category FROM an")
def annotation_files(spark, d):
    """Annotations written and read, each query with its ranks 1 to 10 and labels of 0 to 3."""
    q, image = F.col("query_id").cast("string"), F.col("image_id").cast("string")
    image_path = lambda c: F.concat(F.lit("images/"), c, F.lit(".png"))
    rows = _annotations(spark, d).select(
        F.concat(q, F.lit("-"), F.col("rank").cast("string")).alias("annotation_id"), F.col("query_id").alias("query_index"), q.alias("query_image_id"), "query_category", image_path(q).alias("query_image_path"), "rank",
        F.col("product_id").alias("product_id"), "candidate_category", F.lit(0.5).alias("similarity"), image.alias("candidate_image_id"), image_path(image).alias("candidate_image_path"), "relevance", F.lit("").alias("notes"),
    )
    path = _written(rows)
    found = _back(spark, path, io.read_complete_annotations(spark, path))
    return found.select("annotation_id", F.col("rank").cast("long").alias("rank"), F.col("relevance").cast("long").alias("relevance"), "candidate_category")


@query(f"WITH {G} SELECT image_id, product_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM g")
def gallery_files(spark, d):
    path = _folder(spark)
    io.write_gallery(_gallery(spark, d), path)
    v = F.col("embedding").cast("array<double>")
    return _back(spark, path, io.read_gallery(spark, path)).select("image_id", "product_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query(f"WITH {MANIFEST} SELECT category, split, count(*) AS images FROM mf GROUP BY 1, 2")
def report_files(spark, d):
    """A report of results as JSON lines, written and read."""
    path = _folder(spark)
    io.write_report(_manifest(spark, d).groupBy("category", "split").agg(F.count("*").alias("images")), path)
    return _back(spark, path, io.read_json(spark, path, "category string, split string, images long", lines=True))


@query("SELECT CAST(doc_id AS VARCHAR) AS relative_path, CASE WHEN doc_id % 10 = 1 THEN 'gone' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'new' END AS kind FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def changed_files(spark, d):
    """Of the documents as files a tenth is gone, a tenth has another content and a tenth is new."""
    i = F.col("doc_id")
    rows = adapters.read(spark, d, "documents").select("doc_id", i.cast("string").alias("relative_path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    before = io.content_hashes(rows.where(i % 10 != 3))
    later = rows.where(i % 10 != 1).withColumn("content", F.when(i % 10 == 2, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return io.changed_files(before, io.content_hashes(later))


# --- pixels ---------------------------------------------------------------------------------------------------------------------
#: A grey picture of 8 x 8 pixels for each vector of the gallery.
PIXELS = f"""{G}, px AS (SELECT image_id, list_transform(v[1:64], lambda x: CAST(greatest(0, least(255, floor((x + 0.5::DOUBLE) * 256))) AS DOUBLE)) AS p FROM g)"""


def _pixels(spark, d) -> DataFrame:
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 256))).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 64), byte), ""))
    one = lambda n: F.lit(n).cast("int")
    return _gallery(spark, d).select(F.col("image_id").cast("string").alias("origin"), one(8).alias("width"), one(8).alias("height"), one(1).alias("channels"), data.alias("data"))


@query(f"WITH {PIXELS} SELECT CAST(image_id AS VARCHAR) AS origin, array_to_string(list_transform(p, lambda x: CASE WHEN x > list_avg(p) THEN '1' ELSE '0' END), '') AS bits FROM px")
def average_hashes(spark, d):
    rows = images.fingerprints(_pixels(spark, d), "ahash")
    digit = F.expr("transform(sequence(1, 16), k -> lpad(conv(substring(perceptual_hash, k, 1), 16, 2), 4, '0'))")
    return rows.select("origin", F.array_join(digit, "").alias("bits"))


@query(f"""WITH {PIXELS}, s AS (SELECT image_id, list_avg(p) AS mean, sqrt(list_avg(list_transform(p, lambda x: (x - list_avg(p)) * (x - list_avg(p))))) AS std, list_min(p) AS low, list_max(p) AS high,
               len(list_filter(p, lambda x: x <= 16)) / 64 AS dark, len(list_filter(p, lambda x: x >= 239)) / 64 AS bright FROM px)
           SELECT CAST(image_id AS VARCHAR) AS origin, round_even(mean, 4) AS mean, round_even(std, 4) AS std, low, high, round(dark, 4) AS dark, round(bright, 4) AS bright, 'L' AS mode, CAST(64 AS BIGINT) AS total_pixels FROM s""")
def pixel_quality(spark, d):
    rows = images.quality(_pixels(spark, d))
    return rows.select("origin", "mean", "std", "low", "high", "dark", "bright", "mode", "total_pixels")


@query(f"WITH {PIXELS} SELECT CAST(image_id AS VARCHAR) AS origin, CAST(list_sum(p) AS BIGINT) AS red, CAST(list_sum(p) AS BIGINT) AS green, CAST(list_sum(p) AS BIGINT) AS blue FROM px")
def encoded_pixels(spark, d):
    """Decoded, normalised and encoded to the mean of each channel; undone, these are the sums of the 64 pixels."""
    rows = images.encode(_pixels(spark, d), lambda x: x.astype(np.float64).mean((2, 3)), 8, 3)
    undone = ((F.col("embedding")[k] * std + mean) * 255 * 64 for k, (mean, std) in enumerate(((0.485, 0.229), (0.456, 0.224), (0.406, 0.225))))
    return rows.select("origin", *(F.round(x).cast("long").alias(c) for c, x in zip(("red", "green", "blue"), undone)))
