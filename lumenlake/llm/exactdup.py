"""Exact dedup by a tree merge of sorted digest runs.

Each input partition sorts its documents' digests into a run and collapses equal digests. Runs are then exchanged
in binomial rounds: in round r partitions p and p XOR 2^r hand each other the entries whose digest has the other's
bit r, so after the last round a digest's entries have met in one partition. On arrival the runs are merged
(by Spark's external sort, whose spilled runs a multiway merge joins) and equal digests collapse again, at every
level, so a group of copies is never more than one entry for each run that meets, however many documents it has.

Equality is verified at every level: entries collapse only if SHA-256, length and an independent 64-bit hash of the
normalised text all agree; entries of one digest that differ in another stay apart.

Defined results: null text counts as empty, and empty texts are equal to each other. Of equal texts the one
with the most code points stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat a
doc_id with the same text are one document in two rows: both carry the same result in exact_groups(), and keep_first()
keeps one of them. Rows of one doc_id with texts of equal length that differ in white space alone are told apart by a
hash of the text, the smallest stays. Extra columns, whatever their names, are ignored by digests() and passed through
by keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, map_arrow, shuffle_size

#: Bits of the digest that a round settles: 1 makes the rounds binomial.
RADIX_BITS = 1
#: What equal texts agree in.
KEY = ("digest", "n_norm", "check")
RUN_SCHEMA = pa.schema([("digest", pa.binary()), ("n_norm", pa.int64()), ("check", pa.int64()), ("length", pa.int64()), ("no_id", pa.int8()), ("keep_id", pa.int64()), ("keep_text", pa.int64()), ("group_size", pa.int64()), ("slot", pa.int32())])
RUN = "digest binary, n_norm long, check long, length long, no_id tinyint, keep_id long, keep_text long, group_size long, slot int"


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, n_norm, check, length, row_text) of each row: SHA-256, length and hash of the text without
    white space, length and hash of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("digest"), F.length(bare).cast("long").alias("n_norm"), F.xxhash64(bare).alias("check"), F.length(whole).cast("long").alias("length"), F.xxhash64(whole).alias("row_text"))


def _merger(level: int, bits: int):
    """Collapses equal digests of a sorted stream and names the partition of the next round."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).cast(RUN_SCHEMA)
            rows = rows if held is None else pa.concat_tables([held, rows])
            done, held = _collapse(rows.combine_chunks(), level, bits)
            if done.num_rows:
                yield from done.to_batches()
        if held is not None:
            yield from held.to_batches()

    return merge


def _key(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    _, offsets, data = whole.buffers()
    first = np.frombuffer(offsets, np.int32)[whole.offset]
    return np.frombuffer(data, np.uint8)[first : first + 32 * len(whole)].view(">u8").reshape(-1, 4)


def _collapse(rows: pa.Table, level: int, bits: int) -> tuple[pa.Table, pa.Table]:
    key = _key(rows["digest"])
    columns = {c: rows[c].to_numpy() for c in ("n_norm", "check", "length", "no_id", "keep_id", "keep_text", "group_size", "slot")}
    n_norm, check = columns["n_norm"], columns["check"]
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (n_norm[1:] != n_norm[:-1]) | (check[1:] != check[:-1])])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    order = np.lexsort((columns["keep_text"], columns["keep_id"], columns["no_id"], -columns["length"], group))
    best = order[np.searchsorted(group[order], np.arange(len(first)))]
    digit = (key[first, 0].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    shift = RADIX_BITS * level
    mask = ((1 << RADIX_BITS) - 1) << shift
    target = (columns["slot"][first] & ~mask) | (digit & mask)
    out = pa.table(
        {
            "digest": rows["digest"].take(pa.array(first)),
            "n_norm": n_norm[first],
            "check": check[first],
            **{c: columns[c][best] for c in ("length", "no_id", "keep_id", "keep_text")},
            "group_size": np.add.reduceat(columns["group_size"], first),
            "slot": target.astype(np.int32),
        },
        RUN_SCHEMA,
    )
    return out.slice(0, len(first) - 1), out.slice(len(first) - 1)


def merge_runs(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(digest, n_norm, check, length, keep_id, keep_text, group_size), one row for each text of digests()."""
    wanted = partitions or shuffle_size(rows.sparkSession)
    levels = max(1, -(-(wanted - 1).bit_length() // RADIX_BITS))
    bits, slots = RADIX_BITS * levels, 1 << (RADIX_BITS * levels)
    identity = [F.col("doc_id").isNull().cast("byte").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("keep_id"), F.col("row_text").alias("keep_text")]
    runs = rows.select(*KEY, "length", *identity, F.lit(1).cast("long").alias("group_size"), (F.spark_partition_id() % slots).alias("slot"))
    for level in range(levels):
        runs = map_arrow(runs.sortWithinPartitions(*KEY), _merger(level, bits), RUN).repartitionById(slots, F.col("slot"))
    runs = map_arrow(runs.sortWithinPartitions(*KEY), _merger(0, bits), RUN)
    return runs.select(*KEY, "length", F.expr("if(no_id = 0, keep_id, null)").alias("keep_id"), "keep_text", "group_size")


def _judged(rows: DataFrame, partitions: int | None) -> DataFrame:
    """rows of digests(), which are read twice, with keep_id, group_size and kept."""
    classes = merge_runs(rows, partitions).withColumnRenamed("length", "keep_length")
    joined = rows.join(classes, list(KEY))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")) & (F.col("row_text") == F.col("keep_text")))


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(cut(digests(docs)), partitions).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The row of each group of equal texts that exact_groups() keeps, all columns of docs."""
    return keep_rows(docs, lambda rows: _judged(cut(digests(rows)), partitions).select(F.col("doc_id").alias("row_id"), "row_text", "kept"))
