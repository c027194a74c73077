"""Pixels: decoding, quality, perceptual hashes, preprocessing and encoders, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import abnormal_reasons
from .order import settled

#: Fixed values of the preprocessing: means and deviations of RGB channels.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
DARK, BRIGHT = 16, 239


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, channels, data (BGR bytes) by Spark's image source; width -1 if a file can't be decoded."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """(height, width, 3) as floats; one channel is repeated, and alpha is laid over white."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    if channels == 1:
        return np.repeat(x, 3, 2)
    color = x[:, :, 2::-1]
    if channels == 4:
        alpha = x[:, :, 3:] / 255
        color = color * alpha + 255 * (1 - alpha)
    return color


def luminance(x: np.ndarray) -> np.ndarray:
    return np.floor(x @ np.array([0.299, 0.587, 0.114], np.float32) + 0.5)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with a triangle as wide as the reduction, so that shrinking averages."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        support = max(1.0, scale)
        centre = (np.arange(m) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / support)
        return (w / w.sum(1, keepdims=True)).astype(np.float32)

    y = np.tensordot(weights(x.shape[0], height), x, (1, 0))
    return np.moveaxis(np.tensordot(weights(x.shape[1], width), y, (1, 1)), 0, 1)


def preprocessed(x: np.ndarray, size: int = 224) -> np.ndarray:
    """(3, size, size), normalised."""
    y = (resized(x, size, size) / 255 - np.array(MEAN, np.float32)) / np.array(STD, np.float32)
    if not np.isfinite(y).all():
        raise ValueError("an image has values that aren't finite")
    return np.moveaxis(y, 2, 0)


def dct(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest frequencies of a 32 x 32 picture against their median."""
    small = resized(gray[:, :, None], 32, 32)[:, :, 0]
    low = (dct(32) @ small @ dct(32).T)[:8, :8].ravel()
    return int("".join("1" if v > np.median(low) else "0" for v in low), 2)


def difference_hash(gray: np.ndarray) -> int:
    small = resized(gray[:, :, None], 8, 9)[:, :, 0]
    return int("".join("1" if v else "0" for v in (small[:, 1:] > small[:, :-1]).ravel()), 2)


def average_hash(gray: np.ndarray) -> int:
    small = resized(gray[:, :, None], 8, 8)[:, :, 0]
    return int("".join("1" if v > small.mean() else "0" for v in small.ravel()), 2)


HASHES = {"phash": perceptual_hash, "dhash": difference_hash, "ahash": average_hash}


def _each(images: DataFrame, function: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = function(rgb(bytes(r.data), r.width, r.height, r.channels)) if r.width > 0 and r.height > 0 else {}
                rows.append({"origin": r.origin, **found})
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])

    return images.select("origin", "width", "height", "channels", "data").mapInPandas(run, schema)


def fingerprints(images: DataFrame, kind: str = "phash") -> DataFrame:
    """origin and its 64-bit hash as 16 hex digits; null if it can't be decoded."""
    make = HASHES[kind]
    return _each(images, lambda x: {"perceptual_hash": f"{make(luminance(x)):016x}"}, "origin string, perceptual_hash string")


def quality(images: DataFrame) -> DataFrame:
    """Luminance statistics, reasons and status (valid, warning or invalid) of each image."""

    def look(x: np.ndarray) -> dict:
        y = luminance(x).astype(np.float64)
        if not y.size:
            return {}
        return {"mean": float(y.mean()), "std": float(y.std()), "low": float(y.min()), "high": float(y.max()), "dark": float((y <= DARK).mean()), "bright": float((y >= BRIGHT).mean())}

    stats = _each(images, look, "origin string, mean double, std double, low double, high double, dark double, bright double")
    rows = images.select("origin", "width", "height", "channels").join(stats, "origin")
    mode = F.when(F.col("width") > 0, F.element_at(F.create_map(F.lit(1), F.lit("L"), F.lit(3), F.lit("RGB"), F.lit(4), F.lit("RGBA")), F.col("channels")))
    rows = rows.withColumn("mode", mode).withColumn("readable", F.col("mean").isNotNull()).withColumn("rgb_convertible", F.col("mode").isNotNull())
    rows = rows.withColumn("reason", F.when(~F.col("readable"), F.when(F.col("width") < 0, "decode_error").otherwise("zero_dimension")))
    rows = rows.withColumn("aspect_ratio", F.bround(F.try_divide("width", "height"), 4)).withColumn("total_pixels", F.col("width").cast("long") * F.col("height"))
    rows = rows.withColumn("reasons", abnormal_reasons(F.col("mean"), F.col("std"), F.col("dark"), F.col("bright")))
    status = F.when(F.col("mean").isNull(), "invalid").when(F.size("reasons") > 0, "warning").otherwise("valid")
    return rows.select("origin", "width", "height", "channels", *(F.bround(c, 4).alias(c) for c in ("mean", "std", "low", "high", "dark", "bright")), "reasons", status.alias("status"), "mode", "readable", "rgb_convertible", "reason", "aspect_ratio", "total_pixels")


def rotated(x: np.ndarray, degrees: float, fill: float = 0.0) -> np.ndarray:
    """Turned about the centre, bilinear, size unchanged; what comes from outside is filled."""
    h, w = x.shape[:2]
    a, cy, cx = np.deg2rad(degrees), (h - 1) / 2, (w - 1) / 2
    rows, columns = np.mgrid[0:h, 0:w].astype(np.float64)
    dy, dx = rows - cy, columns - cx
    sy, sx = cy + np.cos(a) * dy + np.sin(a) * dx, cx - np.sin(a) * dy + np.cos(a) * dx
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = (sy - y0)[..., None], (sx - x0)[..., None]
    wide = np.pad(x, ((1, 1), (1, 1), (0, 0)), constant_values=fill)
    at = lambda i, j: wide[np.clip(i + 1, 0, h + 1), np.clip(j + 1, 0, w + 1)]
    return ((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))).astype(np.float32)


#: Fixed value of bicubic sampling: the slope of its kernel at distance 1.
CUBIC = -1.0


def _taps(at: np.ndarray, cubic: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each position the first pixel that it takes from, and the weights of two or four."""
    low = np.floor(at)
    d = np.abs(at - low - np.arange(-1, 3)[:, None, None]) if cubic else np.abs(at - low - np.arange(2)[:, None, None])
    if not cubic:
        return low.astype(int), 1 - d
    near = (CUBIC + 2) * d**3 - (CUBIC + 3) * d**2 + 1
    far = CUBIC * (d**3 - 5 * d**2 + 8 * d - 4)
    return low.astype(int) - 1, np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def turned(x: np.ndarray, degrees: float, cubic: bool = False, grow: bool = False, fill: float = 255.0) -> np.ndarray:
    """Turned counter-clockwise about the centre, bilinear or bicubic. With grow, the canvas gets as large as the turned
    picture needs; else it keeps its size. A pixel whose centre comes from outside is filled; near the edge the edge's
    pixels are repeated."""
    if degrees % 360 == 0:
        return x
    h, w = x.shape[:2]
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    out_h, out_w = h, w
    if grow:
        # Rounded, so that a quarter turn doesn't grow by what rounding makes of a zero.
        corner_x, corner_y = (np.round([sx * w / 2 * u + sy * h / 2 * v for sx in (-1, 1) for sy in (-1, 1)], 9) for u, v in ((c, s), (-s, c)))
        out_w, out_h = (int(np.ceil(p.max() + n / 2) - np.floor(p.min() + n / 2)) for p, n in ((corner_x, w), (corner_y, h)))
    rows, columns = np.mgrid[0:out_h, 0:out_w].astype(np.float64)
    dy, dx = rows + 0.5 - out_h / 2, columns + 0.5 - out_w / 2
    from_x, from_y = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
    outside = (from_x < 0) | (from_x >= w) | (from_y < 0) | (from_y >= h)
    (x0, wx), (y0, wy) = _taps(from_x - 0.5, cubic), _taps(from_y - 0.5, cubic)
    out = np.zeros((out_h, out_w, x.shape[2]))
    for j in range(len(wy)):
        row = np.clip(y0 + j, 0, h - 1)
        line = sum(wx[i][..., None] * x[row, np.clip(x0 + i, 0, w - 1)] for i in range(len(wx)))
        out += wy[j][..., None] * line
    out[outside] = fill
    return np.clip(out, 0, 255).astype(np.float32)


#: Fixed values of the rotation diagnostic: name, degrees, bicubic, growing canvas.
ROTATIONS = (
    ("baseline_0deg", 0.0, False, False),
    ("train_like_plus5deg", 5.0, False, False),
    ("train_like_plus10deg", 10.0, False, False),
    ("controlled_plus12deg", 12.0, False, False),
    ("controlled_minus12deg", -12.0, False, False),
    ("s48_original_plus12deg", 12.0, True, True),
)


def rotations(x: np.ndarray) -> dict[str, np.ndarray]:
    """A picture in the positions of the rotation diagnostic, the unturned one first."""
    return {name: turned(x, degrees, cubic, grow) for name, degrees, cubic, grow in ROTATIONS}


def hsv(x: np.ndarray) -> np.ndarray:
    """RGB from 0 to 255 as hue (in turns, 0 for grey), saturation and value, all from 0 to 1."""
    x = x / 255.0
    value, low = x.max(-1), x.min(-1)
    spread = value - low
    safe = np.where(spread > 0, spread, 1)
    r, g, b = (x[..., k] for k in range(3))
    hue = np.select([value == r, value == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) / 6 % 1
    return np.stack([np.where(spread > 0, hue, 0), np.where(value > 0, spread / np.where(value > 0, value, 1), 0), value], -1)


def from_hsv(y: np.ndarray) -> np.ndarray:
    """The inverse of hsv()."""
    hue, saturation, value = (y[..., k, None] for k in range(3))
    # How far each channel's own hue is, in sixths of a turn.
    away = np.abs((hue * 6 + np.array([0, 4, 2])) % 6 - 3)
    return (255 * value * (1 - saturation * (1 - np.clip(away - 1, 0, 1)))).astype(np.float32)


def hue_turned(x: np.ndarray, turn: float) -> np.ndarray:
    """All hues turned by a part of the circle; saturation and value stay, so grey stays grey."""
    y = hsv(x)
    y[..., 0] = (y[..., 0] + turn) % 1
    return from_hsv(y)


def blended(x: np.ndarray, other: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(other + factor * (x - other), 0, 255).astype(np.float32)


def cropped(x: np.ndarray, height: int, width: int, top: int, left: int) -> np.ndarray:
    return x[top : top + height, left : left + width]


#: Fixed values of the robustness variants: degrees, brightness, the part that a crop keeps, and the least side.
TURN, BRIGHTER, KEPT, SIDE = 12.0, 1.2, 0.9, 32


def variants(x: np.ndarray) -> dict[str, np.ndarray]:
    """The deterministic disturbances of a query image."""
    h, w = x.shape[:2]
    ch, cw = max(SIDE, round(h * KEPT)), max(SIDE, round(w * KEPT))
    return {
        "original": x, "rotation": rotated(x, TURN), "brightness": blended(x, 0.0, BRIGHTER), "center_crop": cropped(x, ch, cw, max(0, (h - ch) // 2), max(0, (w - cw) // 2)),
        "resize": resized(x, max(SIDE, h // 2), max(SIDE, w // 2)),
    }


#: The largest amplitudes that keep an object what it is, the least part of the area that a crop keeps, and
#: the sides' ratio that a crop may have.
MOST_DEGREES, MOST_BRIGHTNESS, MOST_CONTRAST, MOST_SATURATION, MOST_HUE = 15.0, 0.25, 0.25, 0.15, 0.04
LEAST_CROP, CROP_RATIO = 0.85, (0.90, 1.10)


def _between(name: str, value: float, most: float) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= most:
        raise ValueError(f"{name} must be a number between 0 and {most}")


@dataclass(frozen=True)
class Augmentation:
    """Training disturbances that keep an object what it is; amplitudes of 0 switch one off. In this order: crop (the part of
    the area that it keeps), flip, rotation, brightness, contrast, saturation, hue (in turns)."""

    flip: float = 0.5
    degrees: float = 10.0
    brightness: float = 0.15
    contrast: float = 0.15
    saturation: float = 0.08
    hue: float = 0.02
    crop: tuple[float, float] | None = None
    ratio: tuple[float, float] = (0.95, 1.05)

    def __post_init__(self) -> None:
        bounds = (("flip", 1.0), ("degrees", MOST_DEGREES), ("brightness", MOST_BRIGHTNESS), ("contrast", MOST_CONTRAST), ("saturation", MOST_SATURATION), ("hue", MOST_HUE))
        for name, most in bounds:
            _between(name, getattr(self, name), most)
        for name, pair, low, high in (("crop", self.crop or (1, 1), LEAST_CROP, 1), ("ratio", self.ratio, *CROP_RATIO)):
            if len(pair) != 2 or not low <= pair[0] <= pair[1] <= high:
                raise ValueError(f"{name} must be two numbers, rising, between {low} and {high}")

    def apply(self, x: np.ndarray, seed: int, key: str) -> np.ndarray:
        """The disturbance of one image: a function of the seed and its key, whatever the partition."""
        r = np.random.default_rng([seed, *hashlib.md5(key.encode()).digest()])
        if self.crop is not None:
            h, w = x.shape[:2]
            area, ratio = r.uniform(*self.crop), np.exp(r.uniform(*np.log(self.ratio)))
            ch, cw = min(h, max(1, round(h * np.sqrt(area / ratio)))), min(w, max(1, round(w * np.sqrt(area * ratio))))
            x = cropped(x, ch, cw, int(r.integers(0, h - ch + 1)), int(r.integers(0, w - cw + 1)))
        if r.random() < self.flip:
            x = x[:, ::-1]
        if self.degrees:
            x = turned(x, r.uniform(-self.degrees, self.degrees))
        factor = lambda a: r.uniform(1 - a, 1 + a)
        if self.brightness:
            x = blended(x, 0.0, factor(self.brightness))
        if self.contrast:
            x = blended(x, float(np.floor(luminance(x).mean() + 0.5)), factor(self.contrast))
        if self.saturation:
            x = blended(x, luminance(x)[:, :, None], factor(self.saturation))
        if self.hue:
            x = hue_turned(x, r.uniform(-self.hue, self.hue))
        return x


def _encoded(images: DataFrame, make: Callable[[np.ndarray, str], list[tuple[str, np.ndarray]]], encoder, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch[(batch["width"] > 0) & (batch["height"] > 0)].itertuples(index=False):
                made = make(rgb(bytes(r.data), r.width, r.height, r.channels), r.origin)
                out = np.asarray(encoder(np.stack([preprocessed(x, size) for _, x in made])))
                yield pd.DataFrame({"origin": r.origin, "variant": [n for n, _ in made], "embedding": [v.astype(float).tolist() for v in out]})

    return images.select("origin", "width", "height", "channels", "data").mapInPandas(run, "origin string, variant string, embedding array<double>")


def encode_variants(images: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], size: int = 224) -> DataFrame:
    """origin, variant, embedding of each image and each of variants()."""
    return _encoded(images, lambda x, _: list(variants(x).items()), encoder, size)


def encode_rotations(images: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], size: int = 224) -> DataFrame:
    """origin, variant, embedding of each image in the positions of the rotation diagnostic, all in one plan."""
    return _encoded(images, lambda x, _: list(rotations(x).items()), encoder, size)


def rotation_diagnostic(images: DataFrame, gallery: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], k: int = 5, size: int = 224) -> DataFrame:
    """rank_stability() of each image's products in each position against those of the image as it is: one search for all."""
    from .analysis import rank_stability
    from .search import top_products

    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    encoded = encode_rotations(images, encoder, size)
    asked = settled(encoded.select("origin", "variant", F.shiftrightunsigned(F.xxhash64("origin", "variant"), 1).alias("query_id"), "embedding"))
    hits = top_products(asked.select("query_id", "embedding"), gallery, k, False)
    categories = gallery.groupBy("product_id").agg(F.min("category").alias("category"))
    ranked = hits.join(asked.select("query_id", "origin", "variant"), "query_id").join(categories, "product_id")
    return rank_stability(ranked.select(F.col("origin").alias("query_id"), "variant", "product_id", "category", "rank"), ROTATIONS[0][0])


def encode_augmented(images: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], augmentation: Augmentation, role: str = "train", seed: int = 2026, size: int = 224) -> DataFrame:
    """origin, variant ('augmented'), embedding. Only training images may be disturbed: another role is an error."""
    if role != "train":
        raise ValueError(f"augmentation is for training, not for {role!r}")
    return _encoded(images, lambda x, origin: [("augmented", augmentation.apply(x, seed, origin))], encoder, size)


def encode(images: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], size: int = 224, dimension: int | None = None) -> DataFrame:
    """origin and embedding: encoder takes (n, 3, size, size) and returns (n, d). Images that can't be decoded are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[(batch["width"] > 0) & (batch["height"] > 0)]
            if not len(batch):
                continue
            out = np.asarray(encoder(np.stack([preprocessed(rgb(bytes(r.data), r.width, r.height, r.channels), size) for r in batch.itertuples(index=False)])))
            if out.ndim != 2 or len(out) != len(batch) or dimension not in (None, out.shape[1]):
                raise ValueError(f"the encoder returned {out.shape} for {len(batch)} images")
            yield pd.DataFrame({"origin": batch["origin"], "embedding": [v.astype(float).tolist() for v in out]})

    return images.select("origin", "width", "height", "channels", "data").mapInPandas(run, "origin string, embedding array<double>")


#: Query errors: code, HTTP status (fixed values).
ERRORS = (("MISSING_FILE", 400), ("INVALID_IMAGE", 400), ("FILE_TOO_LARGE", 413), ("MODEL_UNAVAILABLE", 503), ("GALLERY_UNAVAILABLE", 503), ("NO_RESULTS", 404), ("INTERNAL_ERROR", 500))
MOST_BYTES, LEAST_SIDE = 10 << 20, 32


class QueryError(ValueError):
    """A query that can't be answered, with its code and HTTP status."""

    def __init__(self, code: str, detail: str = ""):
        self.code, self.status = code, dict(ERRORS)[code]
        super().__init__(f"{code}: {detail}" if detail else code)


def search_images(images: DataFrame, gallery: DataFrame, encoder: Callable[[np.ndarray], np.ndarray] | None, k: int = 5, size: int = 224) -> DataFrame:
    """From image files to products in one plan: decode, preprocess, encode, search, rank and score. images as of
    read_images(); the answer has origin, product_id, category, similarity, rank, similarity_score and the matched images.
    A missing encoder or gallery, and a query without results, are errors with their code."""
    from .search import search

    if encoder is None:
        raise QueryError("MODEL_UNAVAILABLE")
    if gallery is None or gallery.isEmpty():
        raise QueryError("GALLERY_UNAVAILABLE")
    encoded = encode(images, encoder, size)
    queries = encoded.select((-1 - F.shiftrightunsigned(F.xxhash64("origin"), 1)).alias("query_id"), "origin", "embedding")
    hits = search(queries.select("query_id", "embedding"), gallery, k)
    return hits.join(queries.select("query_id", "origin"), "query_id").drop("query_id")


def search_top_images(images: DataFrame, gallery: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], k: int = 5, size: int = 224, exclude: str | None = None) -> DataFrame:
    """From image files to their k nearest gallery images in one plan: origin, image_id, product_id, similarity, rank. exclude
    names a column of images that holds the image_id that a query must not find, its own, where it is in the gallery."""
    from .search import top_images

    own = F.col(exclude).cast("long") if exclude else F.lit(None).cast("long")
    names = images.select("origin", F.coalesce(own, -1 - F.shiftrightunsigned(F.xxhash64("origin"), 1)).alias("query_id"))
    queries = encode(images, encoder, size).join(names, "origin")
    return top_images(queries.select("query_id", "embedding"), gallery, k, exclude is not None).join(names, "query_id").drop("query_id")


def answer(images: DataFrame, gallery: DataFrame, encoder, k: int = 5, size: int = 224) -> list[dict]:
    """search_images() of one query file, checked as a service would: its size, its sides, whether it decodes."""
    rows = images.limit(2).collect()
    if not rows:
        raise QueryError("MISSING_FILE")
    if len(rows) > 1:
        raise QueryError("INVALID_IMAGE", "one image is asked for")
    r = rows[0]
    if r.width < 0 or not r.data:
        raise QueryError("INVALID_IMAGE", "it can't be decoded")
    if r.width < LEAST_SIDE or r.height < LEAST_SIDE:
        raise QueryError("INVALID_IMAGE", f"a side is below {LEAST_SIDE}")
    found = search_images(images, gallery, encoder, k, size).orderBy("rank").collect()
    if not found:
        raise QueryError("NO_RESULTS")
    return [x.asDict() for x in found]


def query_errors(queries: DataFrame) -> DataFrame:
    """Adds error_code to queries (length, width, height): null if they can be searched."""
    code = F.when(F.col("length").isNull() | (F.col("length") == 0), "MISSING_FILE").when(F.col("length") > MOST_BYTES, "FILE_TOO_LARGE").when((F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE), "INVALID_IMAGE")
    return queries.withColumn("error_code", code)
