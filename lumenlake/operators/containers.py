"""What an image file is by its first bytes: format, size and channels without decoding a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pairs import hash_int
from .selection import first_n

#: Which suffixes stand for a format, PNG's channels by colour type, and the JPEG markers that begin a frame
#: and those that have no length.
SUFFIXES = {"JPEG": (".jpg", ".jpeg"), "PNG": (".png",), "GIF": (".gif",), "WEBP": (".webp",), "BMP": (".bmp",), "TIFF": (".tif", ".tiff")}
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
JPEG_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
JPEG_BARE = frozenset(range(0xD0, 0xD9)) | {0x01}
#: Files that a format check looks into.
LOOKED_AT = 64
Found = tuple[str | None, int | None, int | None, int | None]


def _jpeg(b: bytes) -> Found:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return ("JPEG", None, None, None)
        marker = b[at + 1]
        if marker == 0xFF or marker in JPEG_BARE:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack_from(">H", b, at + 2)[0]
        if marker in JPEG_FRAMES:
            if at + 10 > len(b):
                break
            height, width = struct.unpack_from(">HH", b, at + 5)
            return ("JPEG", width, height, b[at + 9])
        at += 2 + size
    return ("JPEG", None, None, None)


def _webp(b: bytes) -> Found:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return ("WEBP", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), 4 if b[20] & 0x10 else 3)
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return ("WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 4 if bits >> 28 & 1 else 3)
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", b, 26)
        return ("WEBP", width & 0x3FFF, height & 0x3FFF, 3)
    return ("WEBP", None, None, None)


def _tiff(b: bytes) -> Found:
    order = "<" if b[:2] == b"II" else ">"
    width = height = channels = None
    at = struct.unpack_from(order + "I", b, 4)[0] if len(b) >= 8 else len(b)
    if at + 2 <= len(b):
        for k in range(struct.unpack_from(order + "H", b, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(b):
                break
            tag, kind = struct.unpack_from(order + "HH", b, entry)
            value = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, entry + 8)[0]
            # Width, height and samples of a pixel.
            width, height, channels = (value if tag == t else v for t, v in ((256, width), (257, height), (277, channels)))
        if width and channels is None:
            channels = 1
    return ("TIFF", width, height, channels)


def container(b: bytes | None) -> Found:
    """format, width, height, channels; what the bytes don't tell is null. A palette counts as one channel."""
    b = b or b""
    if b[:3] == b"\xff\xd8\xff":
        return _jpeg(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        if len(b) < 26 or b[12:16] != b"IHDR":
            return ("PNG", None, None, None)
        width, height = struct.unpack_from(">II", b, 16)
        return ("PNG", width, height, PNG_CHANNELS.get(b[25]))
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return ("GIF", *(struct.unpack_from("<HH", b, 6) if len(b) >= 10 else (None, None)), 1)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return _webp(b)
    if b[:2] == b"BM" and len(b) >= 26:
        size = struct.unpack_from("<I", b, 14)[0]
        if size == 12:
            width, height, _, bits = struct.unpack_from("<HHHH", b, 18)
        elif len(b) >= 30:
            width, height, _, bits = struct.unpack_from("<iiHH", b, 18)
        else:
            return ("BMP", None, None, None)
        return ("BMP", width, abs(height), max(1, bits // 8) if bits != 16 else 3)
    if b[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(b)
    return (None, None, None, None)


def containers(files: DataFrame, key: str = "path") -> DataFrame:
    """key, format, width, height, channels, file_size of files (key, content): format is null where no container begins."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([container(None if c is None else bytes(c)) for c in batch["content"]], columns=["format", "width", "height", "channels"], dtype=object)
            yield pd.concat([batch[[key]].reset_index(drop=True), found, batch["content"].map(lambda c: 0 if c is None else len(c)).rename("file_size").reset_index(drop=True)], axis=1)

    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, format string, width long, height long, channels int, file_size long")


def with_verdict(found: DataFrame, path: str, allowed: tuple[str, ...] = ("JPEG",)) -> DataFrame:
    """Rows of containers() with the suffix of a path column, whether the format fits it, and whether it is allowed. A file
    that is no container fits no suffix and isn't allowed."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    fits = F.coalesce(*(F.when(F.col("format") == f, suffix.isin(*s)) for f, s in SUFFIXES.items()), F.lit(False))
    return found.withColumns({"suffix": suffix, "suffix_fits": fits, "allowed": F.coalesce(F.col("format").isin(*allowed), F.lit(False))})


def format_check(spark: SparkSession, root: str, seed: int = 2026, most: int = LOOKED_AT, allowed: tuple[str, ...] = ("JPEG",)) -> DataFrame:
    """with_verdict() of at most so many files below a folder, drawn by a hash of their path. Only these are opened."""
    from ..sources.io import list_images

    listed = list_images(spark, root)
    chosen = [r.path for r in first_n(listed, hash_int(seed, F.col("relative_path")), most, [F.col("relative_path")]).select("path").collect()]
    if not chosen:
        return with_verdict(containers(spark.createDataFrame([], "path string, content binary")), "path", allowed)
    return with_verdict(containers(spark.read.format("binaryFile").load(chosen)), "path", allowed)


def inspected(spark: SparkSession, root: str) -> DataFrame:
    """images.quality() of the files below a folder, with the format and size of the file, and verified: whether the
    container's own size is that of the decoded picture."""
    from ..sources.io import list_images
    from .images import quality, read_images

    found = containers(list_images(spark, root, True)).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "format", "file_size", F.col("width").alias("_width"), F.col("height").alias("_height"))
    rows = quality(read_images(spark, root))
    rows = rows.join(found, F.regexp_replace("origin", "^file:/+", "/") == F.col("_path"), "left")
    same = F.coalesce((F.col("_width") == F.col("width")) & (F.col("_height") == F.col("height")), F.lit(False))
    return rows.withColumn("verified", same & F.col("readable")).drop("_path", "_width", "_height")
