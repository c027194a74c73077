"""Near-duplicate documents by SimHash, searched with BK-trees.

A fingerprint has a bit for each bit of a 64-bit hash: 1 if over half of the text's shingles, repeats included, have it in
their XXH64. Equal fingerprints are one class from the start. Two are linked if at most `radius` bits differ.

A BK-tree keeps under each node the nodes at one Hamming distance from it, so by the triangle inequality a search within
a radius follows only the edges whose distance is within the radius of its own. Trees stand for shards. Of radius + 1
blocks of bits, two linked fingerprints agree in one, so a shard is all that have one value in one block, and each
fingerprint is in radius + 1 shards. A shard of more than SPLIT is dealt once more, by blocks of its other bits, and what
is then still larger than MOST goes in parts, each two of which meet in one tree. Trees reach their searches by a
shuffle: trees of all fingerprints have no bound in size that would let them be broadcast.

All shards of a task are searched at once, level by level, in numpy. Building a tree already compares each node with all
nodes above it; what that links gives components, and a search doesn't enter a subtree that is in its own component
as a whole. So a family of near copies costs about one comparison each, and a task tells one link for each
fingerprint, not the pairs.

Defined results: null and empty texts, and those of white space, have fingerprint zero and are linked like any other.
Rows that repeat a doc_id are judged by their texts. A null doc_id doesn't count as the smallest: its row has the component
of the documents that it is linked with, null if none of them has a doc_id; links lead on through it. An empty table gives
no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, components, cut, join_unique, map_arrow, row_blocks, text_bytes, words

BITS = 64
SEED = 42
#: Shingles whose hashes are held at once.
AT_ONCE = 1 << 16
#: Fingerprints of a shard beyond which it is dealt once more, and of one tree.
SPLIT, MOST = 20_000, 100_000
#: Steps of searches that are taken at once.
FRONT = 100_000


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one space between them, where each shingle starts and ends there, and where each row's
    shingles begin (and end). Fewer words than width are one shingle, none are none."""
    data = LOWER[data]
    starts, ends = words(data, offsets, NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    long = ends - starts
    end = np.cumsum(long + 1) - 1
    start = end - long
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    joined[np.arange(long.sum()) + np.repeat(np.arange(len(long)), long)] = data[NOT_SPACE[data]]
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    a = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    b = a + np.repeat(np.minimum(n_words, width), n) - 1
    return joined.tobytes(), start[a], end[b], begin


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Each row's fingerprint."""
    text, start, end, begin = shingle_spans(data, offsets, width)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for row, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
        ones = np.zeros(BITS, np.int64)
        for k in range(a, b, AT_ONCE):
            spans = zip(start[k : min(b, k + AT_ONCE)].tolist(), end[k : min(b, k + AT_ONCE)].tolist())
            h = np.array([xxhash.xxh64_intdigest(text[x:y], SEED) for x, y in spans], ">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > b - a).view(">u8")[0]
    return out


def _printer(width: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets):
                own = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(own.view(np.int64))], ["doc_id", "print"])

    return prints


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges a - b reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return label
        # The root of either side learns the smaller label, then every node asks its root.
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(further := label[label], label):
            label = further


class Forest:
    """The BK-trees of shards. prints holds a shard's fingerprints one after another, each once; the first is its root."""

    def __init__(self, prints: np.ndarray, first: np.ndarray, radius: int):
        n = len(prints)
        self.prints, self.radius = prints, radius
        self.root = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.setdiff1d(np.arange(n), first)
        host, levels, linked = self.root[rest], [], []
        while len(rest):
            d = np.bitwise_count(prints[rest] ^ prints[host]).astype(np.int64)
            linked.append((rest[d <= radius], host[d <= radius]))
            at = host * (BITS + 1) + d
            order = np.argsort(at, kind="stable")
            rest, host, d, at = rest[order], host[order], d[order], at[order]
            new = np.concatenate([[True], at[1:] != at[:-1]])
            child = rest[new]
            parent[child], edge[child] = host[new], d[new]
            levels.append(child)
            host = np.repeat(child, np.diff(np.concatenate([np.flatnonzero(new), [len(rest)]])))
            rest, host = rest[~new], host[~new]
        self.linked = [np.concatenate(x) for x in zip(*linked)] if linked else [np.zeros(0, np.int64)] * 2
        self.label = _roots(n, *self.linked)
        # The components of the whole subtree under a node: one, if the smallest and the largest are the same.
        self.low, self.high = self.label.copy(), self.label.copy()
        for child in reversed(levels):
            np.minimum.at(self.low, parent[child], self.low[child])
            np.maximum.at(self.high, parent[child], self.high[child])
        nodes = np.flatnonzero(parent >= 0)
        at = parent[nodes] * (BITS + 1) + edge[nodes]
        order = np.argsort(at)
        self.at, self.child = at[order], nodes[order]
        self.steps = 0

    def _elsewhere(self, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        own = self.label[query]
        return (self.low[node] != own) | (self.high[node] != own)

    def components(self) -> np.ndarray:
        """For each node the first of its shard that links reach."""
        links = [self.linked]
        query = np.arange(len(self.prints))
        d = np.bitwise_count(self.prints ^ self.prints[self.root]).astype(np.int64)
        keep = self._elsewhere(query, self.root)
        front = [(query[keep], self.root[keep], d[keep])]
        while front:
            query, node, d = front.pop()
            if len(query) > FRONT:
                front += [(query[FRONT:], node[FRONT:], d[FRONT:])]
                query, node, d = query[:FRONT], node[:FRONT], d[:FRONT]
            low = np.searchsorted(self.at, node * (BITS + 1) + np.maximum(d - self.radius, 1))
            n = np.searchsorted(self.at, node * (BITS + 1) + np.minimum(d + self.radius, BITS), "right") - low
            child = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            query = np.repeat(query, n)
            keep = self._elsewhere(query, child)
            query, child = query[keep], child[keep]
            d = np.bitwise_count(self.prints[query] ^ self.prints[child]).astype(np.int64)
            self.steps += len(query)
            near = (d <= self.radius) & (self.label[query] != self.label[child])
            links.append((query[near], child[near]))
            if len(query):
                front.append((query, child, d))
        return _roots(len(self.prints), *(np.concatenate(x) for x in zip(*links)))


def _searcher(radius: int):
    """Of rows (shard, low, high, print), sorted by the first three: a link to the first of its component for every other."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        shard = np.stack([rows[c].to_numpy() for c in ("shard", "low", "high")], 1)
        prints = rows["print"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]).any(1)]))
        to = Forest(prints, first, radius).components()
        other = to != np.arange(len(to))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (prints[other], prints[to[other]])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([t for t in (held, pa.Table.from_batches([batch])) if t is not None]).combine_chunks()
            if held.num_rows >= MOST:
                # The last shard may go on in the next batch.
                key = [held[c].to_numpy() for c in ("shard", "low", "high")]
                more = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
                if len(more):
                    yield links(held.slice(0, int(more[-1]) + 1))
                    held = held.slice(int(more[-1]) + 1)
        if held is not None:
            yield links(held)

    return search


def _blocks(n_bits: int, n: int) -> list[tuple[int, int]]:
    """Where n blocks of n_bits begin, and how many bits each has."""
    cuts = [k * n_bits // n for k in range(n + 1)]
    return list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:]))))


def _value(bits: str, at: int, n: int) -> str:
    return f"(shiftrightunsigned({bits}, {at}) & {(1 << n) - 1}L)"


def shards(prints: DataFrame, radius: int, split: int = SPLIT, most: int = MOST) -> DataFrame:
    """(shard, low, high, print): every two of prints (print) at most radius bits apart are together in one (shard, low, high)."""
    outer = _blocks(BITS, radius + 1)
    rows = prints.select("print", F.explode(F.expr(f"array({', '.join(f'{k}L << 32 | {_value('print', at, n)}' for k, (at, n) in enumerate(outer))})")).alias("shard"))
    # At most radius + 1 times two to the bits of a block.
    crowded = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > split).select("shard"))
    if crowded.isEmpty():
        return rows.select("shard", F.lit(0).alias("low"), F.lit(0).alias("high"), "print")
    few = rows.join(F.broadcast(crowded), "shard", "left_anti").withColumn("n", F.lit(0).cast("long"))
    inner = []
    for k, (at, n) in enumerate(outer):
        above = f"shiftrightunsigned(print, {at + n}) << {at}" if at + n < BITS else "0L"
        others = f"({above} | {_value('print', 0, at)})"
        inner.append(f"when {k} then array({', '.join(f'{j + 1}L << 16 | {_value(others, a, m)}' for j, (a, m) in enumerate(_blocks(BITS - n, radius + 1)))})")
    many = rows.join(F.broadcast(crowded), "shard", "left_semi").select("print", "shard", F.explode(F.expr(f"case shard >> 32 {' '.join(inner)} end")).alias("inner"))
    many = many.select("print", F.expr("shard << 24 | inner").alias("shard"))
    large = cut(many.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most))
    many = few.select("print", "shard", "n").unionByName(many.join(large, "shard", "left").select("print", "shard", F.coalesce("n", F.lit(0)).alias("n")))
    parts = f"cast(ceil(n / {max(1, most // 2)}) as int)"
    meet = F.expr(f"if(n = 0, array(0), sequence(0, {parts} - 1))")
    own = F.expr(f"if(n = 0, 0, cast(pmod(xxhash64(print), {parts}) as int))")
    met = many.select("print", "shard", own.alias("own"), F.explode(meet).alias("other"))
    return met.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "print")


def links(prints: DataFrame, radius: int, split: int = SPLIT, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of prints (print, each once) that links connect; together they connect all that links do."""
    dealt = shards(prints, radius, split, most).repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high", "print")
    return map_arrow(dealt, _searcher(radius), "a long, b long").distinct()


def near_groups(docs: DataFrame, radius: int = 4, width: int = 4, split: int = SPLIT, most: int = MOST) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    rows = cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _printer(width), "doc_id long, print long"))
    # A class and its smallest doc_id.
    classes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("rep")))
    label = components(cut(links(classes.select("print"), radius, split, most))).withColumnRenamed("id", "print")
    joined = label.join(classes, "print")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    found = joined.join(least, "component").select("print", "least")
    whole = cut(classes.join(found, "print", "left").select("print", F.coalesce("least", "rep").alias("component_id")))
    return join_unique(rows, whole, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
