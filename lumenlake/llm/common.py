"""Shared pieces: shared-folder checkpoints, Arrow blocks of bytes, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BLOCK_BYTES = 2 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a temporary one serves
    a session of one machine (tests); on a cluster it is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lumenlake-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder. Its files go with the session, or, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, once nothing refers to them."""
    root = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return df.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; the function gets batches of at most BATCH_ROWS rows, so that what it makes of texts doesn't add up.
    (Spark's own batches are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch.)"""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(b.slice(k, BATCH_ROWS) for b in batches for k in range(0, max(1, b.num_rows), BATCH_ROWS))
        finally:
            give_back()

    return df.mapInArrow(sliced, schema)


def give_back() -> None:
    """Returns freed memory to the system: a worker process lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and each row's offsets; null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


#: Odd multiplier of the polynomial hash over bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = powers(size)
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64-bit values: every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums over prefixes; span_hash() turns two of them into the hash of what lies between."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers_for(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = powers_for(len(prefix))[1]
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def table(member: Callable[[int], bool]) -> np.ndarray:
    return np.array([member(b) for b in range(256)], bool)


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of `[^\x20\x09-\x0D]` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` (after lower-casing A-Z).
NOT_SPACE = table(lambda b: b not in SPACES)
WORD = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes; runs end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, A-Z lower-cased, and for each row where its words begin (and end)."""
    data = LOWER[data]
    starts, ends = words(data, offsets, member)
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, offsets)


def crc_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def label_sample(labels: DataFrame, label: str, most: int, held_out_mod: int, held_out: int) -> DataFrame:
    """(doc_id, label, fold) of at most `most` labelled rows that aren't held out, chosen by a hash of
    doc_id; small enough to broadcast by that bound. Where a doc_id repeats, its largest label counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", held_out_mod) != held_out))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("fold", crc_mod("doc_id", held_out_mod).cast("int"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x / max(1, len(x)) + penalty, x.T @ (p - y) / max(1, len(x)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def shuffle_size(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class IdFilter:
    """A bitmap over hashed 64-bit values: `probably` never misses one that it was made from. Its size is bounded;
    over a table too large for it, it lets more rows through and an exact join after it does more of the work.
    Tasks send it in pieces of 4 kB, merged by aggregation, so the driver gets the bits and nothing else."""

    MOST_BITS = 28

    def __init__(self, bits: int, pieces: dict[int, bytes]):
        self.bits, self.bitmap = bits, np.zeros(1 << bits - 3, np.uint8)
        for k, piece in pieces.items():
            self.bitmap[k * 4096 : (k + 1) * 4096] = np.frombuffer(piece, np.uint8)[: len(self.bitmap)]

    @classmethod
    def of(cls, df: DataFrame, column: str) -> IdFilter:
        """df is read twice."""
        bits = max(16, min(cls.MOST_BITS, (16 * max(1, df.count())).bit_length()))
        slot = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - bits)
        slots = df.where(F.col(column).isNotNull()).select((slot / 32768).cast("long").alias("k"), (slot % 32768).alias("at"))
        pieces = slots.groupBy("k").agg(F.bitmap_construct_agg("at").alias("piece"))
        return cls(bits, {r.k: bytes(r.piece) for r in pieces.toLocalIterator()})

    def probably(self, column: pa.Array) -> np.ndarray:
        """For each value of an Arrow column of longs; null never."""
        slot = xxhash64_longs(column.fill_null(0).to_numpy(zero_copy_only=False)) >> np.uint64(64 - self.bits)
        found = self.bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
        return found.astype(bool) & ~np.asarray(column.is_null())


def xxhash64_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64() of longs: XXH64 of their eight bytes."""
    one, two, three, four, five = (np.uint64(p) for p in XXH64_PRIMES)
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = values.astype(np.int64).view(np.uint64)
    h = np.uint64(seed) + five + np.uint64(8) ^ turned(x * two, 31) * one
    h = turned(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


#: The primes of XXH64.
XXH64_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


class SharedTable:
    """A table written as Parquet to the shared folder, for as long as it is needed: a with block deletes it."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/lumenlake-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        delete_folder(self.df.sparkSession, self.path)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.delete()


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, such that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A table of so many longs at most is broadcast (under 100 MB as a hash table); a larger one is joined by shuffles.
MOST_BROADCAST = 2_000_000


def keep_rows(docs: DataFrame, state: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that `state` keeps, all their columns. state gets docs with the columns row_id and row_text
    (doc_id as long, and a hash of the text: what names a row) and gives (row_id, row_text, kept): true for one or more
    of the rows of that name. Of rows alike in both, one stays."""
    i, t = fresh(docs, "row_id"), fresh(docs, "row_text")
    named = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    found = state(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_text")))
    once = found.groupBy("row_id", "row_text").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).where("not kept or copies > 1")
    once = cut(once.select(F.xxhash64("row_id", "row_text").alias("_key"), F.col("row_id").alias("_id"), F.col("row_text").alias("_text"), "kept"))
    key = fresh(docs, "row_key")
    named = named.withColumn(key, F.xxhash64(i, t))
    same = lambda x: (F.col(key) == x["_key"]) & F.col(i).eqNullSafe(x["_id"]) & (F.col(t) == x["_text"])
    sent = F.broadcast(once) if once.count() <= MOST_BROADCAST else once
    single = named.join(sent, same(once), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    again = once.where("kept")
    if again.isEmpty():
        return single
    # Of rows alike, the one of the smallest hash over all columns.
    rows = named.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, same(again), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = rows.groupBy(i, t).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns))).alias("whole"))
    return single.unionByName(rows.select("whole.*"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids in edges (a, b): the smallest id that links reach. Labels travel along links and
    then jump to the label of the label, so the number of rounds grows with the logarithm of the longest path.

    Each round's table is written and read again. (A checkpoint would carry on the size that Spark expects of a table;
    a join's is the product of its sides', so over the rounds it becomes a number of many thousand digits, which
    fills the driver's memory. Of a written table the size is known.)"""
    edges = edges.where("a <> b")
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    with SharedTable(both) as both:
        round_ = SharedTable(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.lit(True).alias("moved"), F.least("id", "m").alias("component")))
        while not round_.df.where("moved").isEmpty():
            label = round_.df.select("id", "component")
            told = both.join(label, both.src == label.id).groupBy("dst").agg(F.min("component").alias("m"))
            step = label.join(told, label.id == told.dst, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("near"))
            far = step.select(F.col("id").alias("_id"), F.col("near").alias("_far"))
            step = step.join(far, step.near == far._id).select("id", (F.col("was") != F.least("near", "_far")).alias("moved"), F.least("near", "_far").alias("component"))
            before, round_ = round_, SharedTable(step)
            before.delete()
    with round_ as table:
        return cut(table.select("id", "component"))




def join_unique(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """rows joined with a table that has one row for each key; rows is read three times. Of a key that holds more than
    a thousandth of the rows there are less than a thousand; these are broadcast, so no task gets all rows of one."""
    held = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = cut(held.where(F.col("_n") * 1000 > rows.count()).select(key))
    often = rows.join(F.broadcast(cut(hot.join(unique, key))), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(unique, key))
