"""Repeated substrings by distributed prefix doubling over sampled positions.

A window is a string of LENGTH bytes inside one document; every byte under a window that also starts anywhere else
is removed. Plain doubling would rank every byte position of the corpus by its first 1, 2, 4, ... bytes, a shuffle
of all positions in every round. Here the first ranks are those of the HALF-byte strings at sampled positions:
each window's anchor is the HALF-byte string in it with the smallest hash (the leftmost of equal ones), which is a
function of the window's content, so equal windows have equal anchors at equal offsets. Windows next to each
other mostly share their anchor: such a run of windows is one row.

Round 1 ranks anchors (HALF bytes) and drops those that occur once: no window over them can repeat.
Round 2 doubles the offset for whole runs: runs of one anchor rank whose whole content is equal repeat in all
their windows, and are decided. A representative of each goes on where its anchor has undecided runs.
Round 3 doubles the offset for the single windows of undecided runs: each is the pair (name of its first HALF
bytes, name of the next HALF), Spark sorts the pairs with their positions, and neighbours of one pair repeat.
Names are fingerprints of 64 bits, and a window's pair keeps the 128 of both: windows behind one passage that many
documents share have one first name, so the second alone tells them apart.

Equal runs and equal windows of one batch travel as one row with the list of their places, so a passage that a third
of all documents share doesn't send a third of all rows to one key. A place is named by one 64-bit key for doc_id and
text. Nothing that grows with the corpus comes to the driver but bitmaps of a fixed largest size.

Defined results: null text counts as empty; texts shorter than LENGTH keep everything, whatever repeats. Rows that
repeat a doc_id are documents of their own (so their windows repeat), told apart by their texts; of equal rows each
gets the same result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, SharedTable, cut, map_arrow, mixed, prefix_hash, shuffle_size, span_hash, text_bytes

LENGTH = 400
PLACE_BITS = 24


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for k in range(len(offsets) - 1):
        yield k, data[offsets[k] : offsets[k + 1]]


def text_name(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little", signed=True)


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by anchor: the anchor's fingerprint, the run's, and its first and last window."""
    half = length // 2
    prefix = prefix_hash(data)
    at = np.arange(len(data) - half + 1)
    name = span_hash(prefix, at, at + half)
    bits = np.uint64(max(PLACE_BITS, len(at).bit_length()))
    key = (name >> bits << bits) | at.astype(np.uint64)
    width, n = length - half + 1, len(data) - length + 1
    pad = -len(key) % width
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    anchor = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return name[anchor], span_hash(prefix, first, last + length), first, last


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Each row's span fields as arrays; null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fields = [column.values.field(k).to_numpy(zero_copy_only=False) for k in range(column.type.value_type.num_fields)]
    offsets, missing = column.offsets.to_numpy(), np.asarray(column.is_null())
    for k in range(len(column)):
        a, b = (0, 0) if missing[k] else (offsets[k], offsets[k + 1])
        yield tuple(f[a:b] for f in fields)


RUN_PLACE = np.dtype([("text", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
RUNS = "g long, u long, n int, key long, lo int, hi int, more binary"


def _sampler(length: int, most: int = 1 << 17):
    """Runs of windows as (g, u, n, key, lo, hi, more): anchor, whole run, how many equal ones this row stands for, the
    place of the first and those of the others."""

    def emit(parts: list) -> pa.RecordBatch:
        g, u, text, lo, hi = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((u, g))
        g, u = g[order], u[order]
        places = np.zeros(len(g), RUN_PLACE)
        places["text"], places["lo"], places["hi"] = text[order], lo[order], hi[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate([first, [len(g)]]))
        ends = np.concatenate([[0], np.cumsum(n - 1)]) * RUN_PLACE.itemsize
        alone = pa.array(n > 1).buffers()[1]
        more = pa.Array.from_buffers(pa.binary(), len(first), [alone, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(places[~new].tobytes())])
        own = places[first]
        return pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(u[first].view(np.int64)), pa.array(n.astype(np.int32)), *(pa.array(own[c].copy()) for c in ("text", "lo", "hi")), more], ["g", "u", "n", "key", "lo", "hi", "more"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k, data in _texts(batch):
                if len(data) < length:
                    continue
                anchor, whole, first, last = runs(data, length)
                key = text_key(ids[k] if ids[k] is not None else -1, text_name(data))
                parts.append((anchor, whole, np.full(len(first), key), first, last))
                held += len(first)
            if held >= most:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return sample


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, hi) of every run that the rows stand for."""
    for batch in batches:
        rest = np.frombuffer(b"".join(x for x in batch.column("more").to_pylist() if x), RUN_PLACE)
        own = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, rest[c]])) for x, c in zip(own, ("text", "lo", "hi"))], ["key", "lo", "hi"])


def _only(column: str, wanted):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted.value.probably(batch.column(column))))
            if some.num_rows:
                yield some

    return pick


def _split_texts(wanted, whole: bool):
    """Adds a key to each text and, unless whole, leaves out rows that can't be wanted; if whole, those keep their
    row but not their text: their result needs no more than their digest."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").fill_null(-1).to_pylist()
            keys = pa.array([text_key(d, text_name(data)) for d, (_, data) in zip(docs, _texts(batch))], pa.int64())
            ask = wanted.value.probably(keys)
            if not whole:
                some = pa.array(ask)
                if ask.any():
                    yield pa.RecordBatch.from_arrays([keys.filter(some), batch.column("text").filter(some)], ["key", "text"])
                continue
            parts = [data for _, data in _texts(batch)]
            digests = [None if a else hashlib.sha256(data.tobytes()).hexdigest() for a, data in zip(ask, parts)]
            texts = pa.array([t if a else None for t, a in zip(batch.column("text").to_pylist(), ask)], pa.string())
            yield pa.RecordBatch.from_arrays([keys, texts, pa.array([len(data) for data in parts], pa.int64()), pa.array(digests, pa.string()), batch.column("doc_id")], ["key", "text", "n_bytes", "digest", "doc_id"])

    return split


TEXTS = "key long, text string, n_bytes long, digest string, doc_id long"


def _windows(length: int, most: int = 1 << 17):
    """Single windows of undecided runs as (n1, n2, n, known, places): equal ones of a batch in one row. known:
    one of them is of a decided run, so all repeat. places: text_key() and first byte of the undecided
    ones."""
    half = length // 2

    def emit(parts: list) -> pa.RecordBatch:
        n1, n2, text, at, known = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((n2, n1))
        n1, n2, known = n1[order], n2[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])]))
        places = np.zeros(int((~known).sum()), PLACE)
        places["text"], places["at"] = text[order][~known], at[order][~known]
        ends = np.concatenate([np.cumsum(~known)[first] - ~known[first], [len(places)]]) * PLACE.itemsize
        binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(places.tobytes())])
        n = np.diff(np.concatenate([first, [len(n1)]]))
        return pa.RecordBatch.from_arrays([pa.array(n1[first].view(np.int64)), pa.array(n2[first].view(np.int64)), pa.array(n.astype(np.int32)), pa.array(np.maximum.reduceat(known.astype(np.int8), first) > 0), binary], ["n1", "n2", "n", "known", "places"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for (k, data), (lo, hi, known) in zip(_texts(batch), _spans(batch.column("spans"))):
                prefix, text = prefix_hash(data), keys[k]
                for a, b, is_known in zip(lo.tolist(), hi.tolist(), known.tolist()):
                    at = np.arange(a, b + 1)
                    parts.append((span_hash(prefix, at, at + half), span_hash(prefix, at + half, at + length), np.full(len(at), text), at, np.full(len(at), is_known)))
                    held += len(at)
                if held >= most:
                    yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)

    return make


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by (n1, n2), the places of pairs that occur twice or more. Of a pair only its first row
    is ever held back, and only while it is alone."""
    held, settled = None, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows.combine_chunks()
        if not rows.num_rows:
            continue
        n1, n2, n = (rows[c].to_numpy() for c in ("n1", "n2", "n"))
        known = rows["known"].to_numpy()
        new = np.concatenate([[True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        repeats = (np.add.reduceat(n, first) > 1) | (np.maximum.reduceat(known.astype(np.int8), first) > 0)
        if settled is not None and (n1[0], n2[0]) == settled:
            repeats[0] = True
        settled = (n1[-1], n2[-1]) if repeats[-1] else None
        keep = repeats[group]
        held = rows.slice(rows.num_rows - 1) if settled is None else None
        if keep.any():
            packed = b"".join(rows["places"].filter(pa.array(keep)).to_pylist())
            places = np.frombuffer(packed, PLACE)
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array(places["text"].copy()), pa.array(places["at"].copy())], ["key", "at"])


PLACE = np.dtype([("text", "<i8"), ("at", "<i4")])


def text_key(doc: int, name: int) -> int:
    """One number for a document's id and its text's name."""
    return int(mixed(np.array([doc, name], np.int64).view(np.uint64))[0:1].view(np.int64)[0] ^ name)


def _cutter(length: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, digest = batch.column("n_bytes").to_pylist(), batch.column("digest").to_pylist()
            removed, pieces = [0] * batch.num_rows, [0] * batch.num_rows
            for (k, data), (lo, hi) in zip(_texts(batch), _spans(batch.column("spans"))):
                if digest[k] is not None:
                    continue
                gone = np.zeros(len(data) + 1, np.int64)
                np.add.at(gone, lo, 1)
                np.add.at(gone, hi + length, -1)
                out = np.cumsum(gone)[:-1] > 0
                removed[k] = int(out.sum())
                pieces[k] = int(np.count_nonzero(out[1:] & ~out[:-1]) + out[:1].sum())
                digest[k] = hashlib.sha256(data[~out].tobytes()).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return finish


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[SharedTable]]:
    """(key, lo, hi): windows lo to hi of the text of a text_key() repeat; and the tables that it reads, to be deleted
    when it has been used."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with SharedTable(map_arrow(docs, _sampler(length), RUNS)) as sampled:
        # Round 1: anchors that occur twice.
        twice = cut(sampled.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"))
        likely = sc.broadcast(IdFilter.of(twice, "g"))
        rows = SharedTable(map_arrow(sampled, _only("g", likely), sampled.schema).join(twice, "g"))
    # Round 2: whole runs of one anchor.
    by_run = SharedTable(rows.df.groupBy("g", "u").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("r")))
    decided = map_arrow(rows.df.join(by_run.df.where("n > 1").select("g", "u"), ["g", "u"], "left_semi").select("key", "lo", "hi", "more"), _places, "key long, lo int, hi int")
    undecided = by_run.df.groupBy("g").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone")).where("alone > 0").select("g")
    active = cut(by_run.df.join(undecided, "g", "left_semi").select("r.*", (F.col("n") > 1).alias("known")))
    # Round 3: single windows.
    # Sets: rows alike share a key, and each of them names the same places.
    spans = active.groupBy("key").agg(F.collect_set(F.struct("lo", "hi", "known")).alias("spans"))
    wanted = sc.broadcast(IdFilter.of(active.select("key"), "key"))
    texts = map_arrow(docs, _split_texts(wanted, False), "key long, text string")
    texts = texts.join(spans, "key")
    windows = map_arrow(texts, _windows(length), "n1 long, n2 long, n int, known boolean, places binary")
    pairs = windows.repartition(shuffle_size(docs.sparkSession), "n1", "n2").sortWithinPartitions("n1", "n2")
    found = map_arrow(pairs, _neighbours, "key long, at int")
    return decided.unionByName(found.select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))), [rows, by_run]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what is left."""
    found, tables = repeated_spans(docs, length)
    try:
        spans = cut(found.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    finally:
        for t in tables:
            t.delete()
    wanted = docs.sparkSession.sparkContext.broadcast(IdFilter.of(spans.select("key"), "key"))
    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _split_texts(wanted, True), TEXTS)
    joined = rows.join(spans, "key", "left").select("doc_id", "n_bytes", "digest", "text", "spans")
    return map_arrow(joined, _cutter(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
