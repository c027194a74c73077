"""Benchmark decontamination by suffix arrays over the training documents.

A shard is a block of documents. Its suffix array holds the document positions that can begin a match (a
probe of the first words of every test window, kept as a hash bitmap, leaves out the rest), ordered by
successive refinement: at depth d the suffixes of one d-word prefix are sorted by their next word, so that
(prefix rank, next word) rises along the array. Every test suffix is looked up by binary search over that
order, one word deeper at a time, for all test suffixes at once; the range narrows until it is empty, or holds every
location of the whole window. What is found is extended to the longest verbatim match: each location is looked up, by binary
search again, among the sorted suffixes of the items, whose neighbours share the longest prefix with it.

The test side goes to the executors in blocks of at most MOST_WORDS words, MOST_BLOCKS of them in one pass over the
documents. A larger benchmark takes several passes, each of which gives only the documents that it hits, and their
results are merged by document, so neither the driver nor a task holds more than one pass's blocks.

Defined results: A-Z count as a-z; words are runs of digits, letters a-z and anything beyond ASCII. Null or
empty texts have no words, hit nothing and contain nothing. An item of fewer words than the window is one
window; an item without words has none. The windows of an item without item_id count as hit, only its id is missing
from item_ids. Items with one text are items of their own. With an empty benchmark
nothing is hit. Rows that repeat are judged one by one. Extra columns are ignored, or kept by clean().
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MOST_BROADCAST, WORD, cut, fresh, map_arrow, mixed, powers_for, prefix_hash, row_blocks, span_hash, text_bytes, words

WINDOW = 10
MOST_WORDS = 200_000
MOST_BLOCKS = 8
PROBE_WORDS = 4
BITMAP_BITS = 20


def _hashes(column: pa.Array, first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of rows first to last, and where each row's words begin."""
    part, at = LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
    starts, ends = words(part, at, WORD)
    return span_hash(prefix_hash(part), starts, ends), np.searchsorted(starts, at)


def _run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def _word_prefix(h: np.ndarray) -> np.ndarray:
    """Sums over prefixes of word hashes; _run() turns two of them into a hash of the words between."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h | np.uint64(1)) * powers_for(len(h) + 1)[0][:-1], out=out[1:])
    return out


def _run(prefix: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (prefix[start + n] - prefix[start]) * powers_for(len(prefix))[1][start]


def _common(one: np.ndarray, at: np.ndarray, room: np.ndarray, two: np.ndarray, other: np.ndarray, other_room: np.ndarray) -> np.ndarray:
    """How many words the texts of two prefix sums have in common from each pair of places on."""
    low, high = np.zeros(len(at), np.int64), np.minimum(room, other_room)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = _run(one, at, middle) == _run(two, other, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Windows:
    """The distinct windows of a block of items, as word hashes, with the items that have each; and the items' suffixes in
    order."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        rows: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, h) in enumerate(items):
            n = min(window, len(h))
            for i in range(len(h) - n + 1 if n else 0):
                rows.setdefault(h[i : i + n].tobytes(), (h[i : i + n], set()))[1].add(k)
        found = sorted(rows.values(), key=lambda x: len(x[0]))
        self.window = window
        self.length = np.array([len(h) for h, _ in found], np.int64)
        self.words = np.zeros((len(found), window), np.uint64)
        for k, (h, _) in enumerate(found):
            self.words[k, : len(h)] = h
        self.items = [np.array(sorted(x), np.int64) for _, x in found]
        self.probe = int(min(PROBE_WORDS, self.length.min())) if found else 0
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        for w in self.words:
            self.bitmap[_run_hash(w[: self.probe], self.probe) >> np.uint64(64 - BITMAP_BITS)] = True
        self._sort([h for _, h in items])

    def _sort(self, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(h) for h in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.text = np.concatenate([*texts, np.zeros(0, np.uint64)])
        self.room = np.repeat(self.begins[1:], sizes) - np.arange(len(self.text))
        # Prefix doubling: ranks of 1, 2, 4, ... words; a suffix ends with its item.
        rank = np.unique(self.text, return_inverse=True)[1] + 1
        order, width = np.argsort(rank, kind="stable"), 1
        while width < max(1, self.room.max(initial=0)):
            later = np.where(self.room > width, rank[np.minimum(np.arange(len(rank)) + width, len(rank) - 1)], 0)
            order = np.lexsort((later, rank))
            new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])])
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            width *= 2
        self.order = order

    def longest(self, h: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of the items with the documents' words from each place on: its length, and where in the
        items' text it is."""
        if not len(self.text) or not len(at):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        mine, theirs = _word_prefix(h), _word_prefix(self.text)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        while (low < high).any():
            open_ = low < high
            middle = np.minimum((low + high) // 2, len(self.order) - 1)
            q = self.order[middle]
            n = _common(mine, at, room, theirs, q, self.room[q])
            # Which is less: the suffix that ends first, or the one with the smaller next word.
            left = np.where(n < room, h[np.minimum(at + n, len(h) - 1)], np.uint64(0))
            right = np.where(n < self.room[q], self.text[np.minimum(q + n, len(self.text) - 1)], np.uint64(0))
            more = (n < self.room[q]) & ((n >= room) | (left < right))
            low, high = np.where(open_ & ~more, middle + 1, low), np.where(open_ & more, middle, high)
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for near in (low - 1, low):
            q = self.order[np.clip(near, 0, len(self.order) - 1)]
            n = _common(mine, at, room, theirs, q, self.room[q])
            better = n > best
            best, where = np.where(better, n, best), np.where(better, q, where)
        return best, where


def read_items(items: DataFrame, window: int, most_words: int = MOST_WORDS) -> Iterator[Windows]:
    """The benchmark in blocks. The driver holds one block at a time."""
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        data, offsets = text_bytes(pa.array([row.text]))
        h, _ = _hashes(None, 0, 1, data, offsets)
        block.append((row.item_id, h))
        held += len(h)
        if held > most_words:
            yield Windows(block, window)
            block, held = [], 0
    yield Windows(block, window)


def _suffix_search(h: np.ndarray, ends: np.ndarray, tests: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test window: its longest match in this shard, and the range of the suffix array that has it
    whole (empty if it isn't there); then the array. h: word hashes; ends: where the document of each word ends."""
    n_tests, probe = len(tests.length), tests.probe
    longest, low, high = (np.zeros(n_tests, np.int64) for _ in range(3))
    run = _run_hash(h, probe) if len(h) >= probe else np.zeros(0, np.uint64)
    array = np.flatnonzero(tests.bitmap[run >> np.uint64(64 - BITMAP_BITS)])
    array = array[array + probe <= ends[array]]
    if not len(array):
        return longest, low, high, array
    vocabulary = np.unique(tests.words)
    spread = np.int64(len(vocabulary) + 2)

    def rank_of(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        return np.where(vocabulary[at] == x, at + 1, 0).astype(np.int64)

    # word ranks of the suffixes, a column for each depth; -1 beyond the document, 0 for words of no test
    depth = [np.where(array + d < ends[array], rank_of(h[np.minimum(array + d, len(h) - 1)]), -1) for d in range(tests.window)]
    order = np.lexsort(depth[::-1])
    array, depth = array[order], [x[order] for x in depth]
    prefix = np.zeros(len(array), np.int64)
    test_prefix, alive = np.zeros(n_tests, np.int64), np.ones(n_tests, bool)
    high[:] = len(array)
    for d in range(tests.window):
        key = prefix * spread + depth[d] + 1
        ask = alive & (d < tests.length)
        want = test_prefix * spread + rank_of(tests.words[:, d]) + 1
        left, right = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        found = ask & (left < right)
        low, high = np.where(found, left, low), np.where(found, right, high)
        longest += found
        alive &= found | (d >= tests.length)
        prefix = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        test_prefix = np.where(found, prefix[np.minimum(left, len(array) - 1)], test_prefix)
    whole = longest == tests.length
    return longest, np.where(whole, low, 0), np.where(whole, high, 0), array


#: The longest verbatim match of a document: words, where in the document, of which item, where in it.
BEST = ("longest", "longest_at", "longest_item", "longest_item_at")


def _judge(h: np.ndarray, first: np.ndarray, tests: Windows):
    """For each document of a shard: words hit, the items with windows in it (as indexes), and its longest match."""
    rows = len(first) - 1
    owner = np.repeat(np.arange(rows), np.diff(first))
    ends = first[1:][owner]
    _, low, high, array = _suffix_search(h, ends, tests)
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(rows)]
    found = []
    for t in np.flatnonzero(high > low):
        at = array[low[t] : high[t]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + tests.length[t], -1)
        found.append(at)
        for doc in np.unique(owner[at]):
            items[doc].update(tests.items[t].tolist())
    best: list[tuple | None] = [None] * rows
    if found:
        at = np.unique(np.concatenate(found))
        n, where = tests.longest(h, at, ends[at] - at)
        item = np.searchsorted(tests.begins, where, "right") - 1
        # Of each document the longest, the first of equal ones.
        for k in np.lexsort((-at, n)):
            best[owner[at[k]]] = int(n[k]), int(at[k] - first[owner[at[k]]]), tests.names[item[k]], int(where[k] - tests.begins[item[k]])
    return np.cumsum(cover)[:-1] > 0, items, best


def _scan(column: pa.Array, blocks: list[Windows]) -> Iterator[tuple]:
    """(first row, rows, word counts, where the words of each row begin, hit, item names of each row, longest match of
    each row) by shards."""
    data, offsets = text_bytes(column)
    for first, last in row_blocks(offsets):
        h, starts = _hashes(None, first, last, data, offsets)
        rows = last - first
        names: list[set[str]] = [set() for _ in range(rows)]
        hit, best = np.zeros(len(h), bool), [None] * rows
        for windows in blocks:
            if not len(windows.length) or not len(h):
                continue
            more, items, runs = _judge(h, starts, windows)
            hit |= more
            for k, found in enumerate(items):
                names[k].update(windows.names[x] for x in found if windows.names[x] is not None)
            best = [b if a is None or b is not None and b[0] > a[0] else a for a, b in zip(best, runs)]
        yield first, rows, np.diff(starts), starts, hit, names, best


def _best_columns(best: list[tuple | None]) -> list[pa.Array]:
    return [pa.array([b[k] if b else None for b in best], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]


def _scanner(tests, keep: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = pickle.loads(tests.value)
        for batch in batches:
            for first, rows, n_words, starts, hit, names, best in _scan(batch.column("text"), blocks):
                n_hit = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.int64), starts[:-1]) * (n_words > 0) if rows else np.zeros(0, np.int64)
                part = batch.slice(first, rows)
                if keep:
                    clean = part.filter(pa.array(n_hit == 0))
                    if clean.num_rows:
                        yield clean
                else:
                    ids = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n_hit), ids, *_best_columns(best)], ["doc_id", "n_words", "n_hit", "item_ids", *BEST])

    return scan


def _hit_rows(tests):
    """Of documents with hits alone: row_key, the spans of words that are hit, item_ids and the longest match."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = pickle.loads(tests.value)
        for batch in batches:
            for first, rows, n_words, starts, hit, names, best in _scan(batch.column("text"), blocks):
                some = [k for k in range(rows) if best[k]]
                if not some:
                    continue
                spans = []
                for k in some:
                    edge = np.diff(np.concatenate([[0], hit[starts[k] : starts[k + 1]].astype(np.int8), [0]]))
                    spans.append([{"a": a, "b": b} for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())])
                key = batch.column("row_key").slice(first, rows).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([key, pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(names[k]) for k in some], pa.list_(pa.string())), *_best_columns([best[k] for k in some])], ["row_key", "spans", "item_ids", *BEST])

    return scan


FOUND = "item_ids array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def _passes(items: DataFrame, window: int, most_words: int) -> Iterator:
    """The benchmark as broadcasts of MOST_BLOCKS blocks, and whether it is the last one; one at least. A pass is made when it
    is asked for, so the driver holds one and a block."""
    sc, held = items.sparkSession.sparkContext, []
    for block in read_items(items, window, most_words):
        if len(held) == MOST_BLOCKS:
            yield sc.broadcast(pickle.dumps(held)), False
            held = []
        held.append(block)
    yield sc.broadcast(pickle.dumps(held)), True


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _merged(docs: DataFrame, first, rest: Iterator) -> DataFrame:
    """row_key, n_hit, item_ids and the longest match of the documents that any pass hits. A pass's hits are written
    and its broadcast destroyed before the next one is made."""
    rows = docs.select(_key().alias("row_key"), "text")
    found = None
    for tests in itertools.chain([first], (t for t, _ in rest)):
        # Rows alike have one key and the same hits.
        part = cut(map_arrow(rows, _hit_rows(tests), f"row_key long, spans array<struct<a:long,b:long>>, {FOUND}").dropDuplicates(["row_key"]))
        tests.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("longest", (-F.col("longest_at")).alias("m"), "longest_at", "longest_item", "longest_item_at")).alias("best")
    found = found.groupBy("row_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best)
    # Spans in order: each adds what lies beyond the furthest end so far.
    start = "named_struct('n', 0L, 'end', 0L)"
    step = "named_struct('n', acc.n + greatest(0L, s.b - greatest(acc.end, s.a)), 'end', greatest(acc.end, s.b))"
    n_hit = F.expr(f"aggregate(spans, {start}, (acc, s) -> {step}, acc -> acc.n)")
    return cut(found.select("row_key", n_hit.alias("n_hit"), "item_ids", *(f"best.{c}" for c in BEST)))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, item_ids (sorted), and its longest verbatim match with an item:
    longest (words), longest_at, longest_item, longest_item_at (places count words from 0; null without any)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = _passes(items, window, most_words)
    first, only = next(passes)
    if only:
        return map_arrow(docs, _scanner(first, False), f"doc_id long, n_words long, n_hit long, {FOUND}")
    found = _merged(docs, first, passes)
    rows = map_arrow(docs.withColumn("row_key", _key()), _count_words, "doc_id long, row_key long, n_words long")
    rows = rows.join(F.broadcast(found) if found.count() <= MOST_BROADCAST // 8 else found, "row_key", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), *BEST)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, n_words, *_ in _scan(batch.column("text"), []):
            part = batch.slice(first, rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(n_words)], ["doc_id", "row_key", "n_words"])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of docs in which no window occurs, all their columns. One pass and no shuffle for a benchmark of
    MOST_BLOCKS blocks."""
    passes = _passes(items, window, most_words)
    first, only = next(passes)
    if only:
        return map_arrow(docs, _scanner(first, True), docs.schema)
    found, key = _merged(docs, first, passes).select("row_key"), fresh(docs, "row_key")
    found = found.withColumnRenamed("row_key", key)
    kept = docs.withColumn(key, _key()).join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, key, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def leak_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    found = find_leaks(docs, items, window, most_words)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
