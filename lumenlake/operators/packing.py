"""Many rows of a few numbers as few rows of arrays, which take a third of the bytes where they are shuffled or written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition that are packed together, and numbers of an array at most where groups are packed again.
PACK, CHUNK = 1 << 20, 1 << 16


def whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all arrays of a column."""
    return whole(column).flatten().to_numpy(zero_copy_only=False)


def gaps_of(values: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Numbers, 0 or more, that rise from each start (place of values) on: of each start their differences, seven bits a
    byte, the lowest first, and a bit if more follow."""
    gap = np.diff(values, prepend=0)
    gap[starts] = values[starts]
    gap = gap.astype(np.uint64)
    size = np.ones(len(gap), np.int64)
    for k in range(7, 63, 7):
        more = gap >= 1 << k
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out, first = np.empty(ends[-1] if len(ends) else 0, np.uint8), ends - size
    for k in range(size.max(initial=0)):
        own = np.flatnonzero(size > k)
        out[first[own] + k] = (gap[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (size[own] > k + 1).astype(np.uint8) << 7
    offsets = np.append(first[starts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def from_gaps_of(rows: list[bytes], times: np.ndarray) -> np.ndarray:
    """The numbers of rows of gaps_of() with so many (one or more) each."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.flatnonzero(data < 128)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, gap = ends - first + 1, np.zeros(len(ends), np.int64)
    for k in range(size.max(initial=0)):
        own = np.flatnonzero(size > k)
        gap[own] |= (data[first[own] + k] & 127).astype(np.int64) << 7 * k
    upto, starts = np.cumsum(gap), np.cumsum(times) - times
    return upto - np.repeat((upto - gap)[starts], times) if len(starts) > 1 else upto


def gaps(values: np.ndarray) -> bytes:
    """gaps_of() one start."""
    return gaps_of(values, np.zeros(1, np.int64))[0].as_py() if len(values) else b""


def from_gaps(data: bytes) -> np.ndarray:
    return from_gaps_of([data], np.zeros(1, np.int64))


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    code = np.zeros(len(table), np.int64)
    for k in keys:
        own = whole(table[k]).dictionary_encode()
        size = len(own.dictionary) + 1
        code = code * size + own.indices.fill_null(size - 1).to_numpy(zero_copy_only=False)
        # Dense again, so that no product leaves 64 bits.
        code = np.unique(code, return_inverse=True)[1] if len(keys) > 2 else code
    return code


def _grouped(table: pa.Table, keys: list[str], values: list[str], least: str | None) -> pa.RecordBatch:
    if least:
        table = table.take(pa.array(np.argsort(table[least].to_numpy(), kind="stable")))
        table = table.take(pa.array(np.unique(_codes(table, [*keys, *(v for v in values if v != least)]), return_index=True)[1]))
    code = _codes(table, keys)
    code = code.astype(np.uint16) if code.max() < 1 << 16 else code
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = pa.array(np.append(starts, len(code)).astype(np.int32))
    first = pa.array(order[starts])
    lists = [pa.ListArray.from_arrays(ends, whole(table[v]).take(pa.array(order))) for v in values]
    return pa.RecordBatch.from_arrays([*(whole(table[k]).take(first) for k in keys), *lists], [*keys, *values])


def packed(rows: DataFrame, keys: list[str], values: list[str], least: str | None = None) -> DataFrame:
    """keys, and values as arrays: a row for each value of keys among some million rows of a partition. Of those that differ
    in the column `least` only, one with the least value is kept."""
    rows = rows.select(*keys, *values)
    names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK:
                yield _grouped(pa.Table.from_batches(held), keys, values, least)
                held, n = [], 0
        if n:
            yield _grouped(pa.Table.from_batches(held), keys, values, least)

    return rows.mapInArrow(pack, ", ".join([*(f"{k} {names[k]}" for k in keys), *(f"{v} array<{names[v]}>" for v in values)]))


def chunks(columns: dict[str, np.ndarray]) -> dict[str, pa.ListArray]:
    """Columns of equal length as arrays of some thousand numbers each."""
    n = len(next(iter(columns.values())))
    ends = pa.array(np.append(np.arange(0, n, CHUNK), n).astype(np.int32))
    return {k: pa.ListArray.from_arrays(ends, pa.array(v)) for k, v in columns.items()}


def unpacked(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.select(*keys, F.inline(F.arrays_zip(*values)))
