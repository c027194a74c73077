"""Near-duplicate documents by circulant MinHash.

A document is its set of shingles. Two fixed permutations of D slots give all HASHES signature coordinates:
sigma scatters the shingles, and coordinate k is the smallest value that pi, shifted circularly by k, gives to
one of them. Coordinates are banded (BANDS of ROWS); documents of one band value are candidates.

Equal sets are one class from the start, so exact copies cost one row each. In each bucket every class is compared
with one of the bucket only, its leader; links are confirmed on the full sets, and a sketch of the signature leaves out
pairs 5 standard deviations below what could matter. That joins most of a family in one component.

What is left is settled exactly, and without listing pairs of a family. A group is all that was compared with the
leaders of one component, whether it was linked or not; one of those leaders, L, stands for it. Let D(x) be the shingles
in which x differs from L, and r(x) how many of L's it lacks. Then x and y share |L| - r(x) - r(y) + |D(x) & D(y)|
shingles, so a link asks for a known number of common differences, at least one if y isn't linked to L (it follows from
the threshold), as is so for every y outside the component. By the prefix filter it is enough to look at each class's
rarest differences, rarest among those of the outsiders first: an outsider and a class of another component that share
one of them, and could still reach the number, are compared on their full sets. Classes edited independently of each
other share next to none, so the work follows the number of classes and not of pairs.

With 28 bands of 5 rows a link of similarity 0.85 misses all bands once in 10**7. Defined results: null and empty
texts have no shingles, link with nothing and are their own component; a null doc_id links with nothing, has no
component and is kept; rows that repeat a doc_id are judged by their texts, and those with the same text share one
result, of which keep_representatives() keeps one row. Extra columns, whatever their names, are ignored, or kept by
keep_representatives().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, NOT_SPACE, IdFilter, SharedTable, components, cut, keep_rows, map_arrow, mixed, row_blocks, text_bytes, word_hashes

SLOT_BITS = 20
BANDS, ROWS = 28, 5
#: The first BANDS * ROWS coordinates are banded; all of them make the sketch.
HASHES = 280
SKETCH = -(-HASHES // 16)  # longs of 16 four-bit coordinates
#: So many of a leader's pairs at most are compared with one copy of its set.
PART = 256


def near_percent(percent: int) -> int:
    """A class less similar than this to its bucket's leader can't be linked to one that is linked to the leader."""
    return max(0, 2 * percent - 100)


def least_equal(percent: int, deviations: float) -> int:
    """How many 4-bit coordinates of two sketches are equal at a similarity, less so many standard deviations."""
    p = percent / 100 * 15 / 16 + 1 / 16
    return int(HASHES * p - deviations * (HASHES * p * (1 - p)) ** 0.5)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and for each slot a row of the HASHES values that pi's shifts give it (a view of one array)."""
    r = np.random.default_rng(20260101)
    size = 1 << SLOT_BITS
    sigma, pi = r.permutation(size).astype(np.int32), r.permutation(size).astype(np.int32)
    ring = np.concatenate([pi, pi[: HASHES + 1]])
    return sigma, np.lib.stride_tricks.sliding_window_view(ring, HASHES)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes; fewer words than width are one shingle."""
    h, first = word_hashes(data, offsets, NOT_SPACE)
    if len(h) >= width:
        run = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h[k])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    sigma, shifted = permutations()
    slots = sigma[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    best = shifted[slots[:256]].min(0)
    for k in range(256, len(slots), 256):
        np.minimum(best, shifted[slots[k : k + 256]].min(0), out=best)
    return best


def _sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: two sums of hashes, which name it together with its size, and one number for all three."""
    k1 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    k2 = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
    n = np.array([len(s) for s in sets], np.uint64)
    return k1.view(np.int64), k2.view(np.int64), mixed(k1 ^ mixed(k2 + mixed(n))).view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.array([len(s) for s in sets], np.int64)
                k1, k2, name = _sums(sets)
                signed = np.stack([signature(s) if len(s) else np.zeros(HASHES, np.int32) for s in sets]).astype(np.uint64)
                bands = np.repeat(salts[None], b - a, 0)
                for r in range(ROWS):
                    bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + signed[:, r : BANDS * ROWS : ROWS])
                nibbles = np.zeros((b - a, SKETCH * 16), np.uint64)
                nibbles[:, :HASHES] = mixed(signed) & np.uint64(15)
                sketch = np.bitwise_or.reduce(nibbles.reshape(b - a, SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), 2)
                rows = np.arange(b - a + 1)
                lists = [pa.ListArray.from_arrays(pa.array((rows * x.shape[1]).astype(np.int32)), pa.array(x.ravel().view(np.int64))) for x in (bands, sketch)]
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "row_text")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in (n, k1, k2, name)), *lists], ["doc_id", "row_text", "n", "k1", "k2", "id", "bands", "sketch"])

    return sign


SIGNED = "doc_id long, row_text long, n long, k1 long, k2 long, id long, bands array<long>, sketch array<long>"


def _set_maker(width: int, wanted):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.probably(batch.column("doc_id"))))
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(_sums(sets)[2]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "id", "shingles"])

    return make


def _equal_nibbles(a: str, b: str) -> str:
    """SQL for the number of equal 4-bit coordinates of two sketches."""
    words = []
    for k in range(SKETCH):
        x = f"({a}[{k}] ^ {b}[{k}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        words.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & 1229782938247303441L)")
    return f"({HASHES} - ({' + '.join(words)}))"


class _Linker:
    """Finds the components of docs (doc_id, text, row_text). A class of equal sets goes by `id`, a 64-bit name of
    its size and two sums of hashes."""

    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs, self.percent, self.width = docs, percent, width

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """The rows (doc_id, row_text, n, id), and (id, root, component) of each class of equal sets: a class that stands
        for all that its links reach, and the smallest doc_id of those."""
        with SharedTable(map_arrow(self.docs, _signer(self.width), SIGNED)) as rows:
            known = rows.where("n > 0 and doc_id is not null")
            reps = cut(known.groupBy("id").agg(F.min("doc_id").alias("rep")))
            # Signature and set of a class are those of the row with its smallest doc_id.
            signed = known.join(reps.select("id", F.col("rep").alias("doc_id")), ["id", "doc_id"], "left_semi")
            signed = SharedTable(signed.select("id", "doc_id", "n", "bands", "sketch").dropDuplicates(["id"]))
            narrow = cut(rows.select("doc_id", "row_text", "n", "id"))
        with signed as table:
            spread = table.select("id", F.explode("bands").alias("b"))
            shared = cut(spread.join(spread.groupBy("b").agg(F.count("*").alias("c")).where("c > 1"), "b").select("b", "id", "c").distinct())
            # A bucket's leader is the class that shares buckets with most others, so the one most of its group is near to.
            weight = shared.groupBy("id").agg(F.sum("c").alias("weight"))
            leaders = shared.join(weight, "id").groupBy("b").agg(F.max(F.struct("weight", "id")).alias("m")).select("b", F.col("m.id").alias("leader"))
            pairs = cut(shared.join(leaders, "b").where("id <> leader").select("leader", "id").distinct())
            # The sketches and sets of the classes that share a bucket with another.
            inside = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
            self.sketches = cut(table.join(inside, "id", "left_semi").select("id", "doc_id", "n", "sketch"))
        wanted = self.docs.sparkSession.sparkContext.broadcast(IdFilter.of(self.sketches.select("doc_id"), "doc_id"))
        sets = map_arrow(self.docs.select("doc_id", "text"), _set_maker(self.width, wanted), "doc_id long, id long, shingles array<long>")
        sets = sets.join(self.sketches.select("id", "doc_id"), ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")
        with SharedTable(sets) as self.sets:
            tried = cut(self.compare(pairs.select(F.col("leader").alias("a"), F.col("id").alias("b"))))
            links = tried.where(self.linked()).select("a", "b")
            label = components(links)
            rest = cut(self.left_over(pairs, label))
            if not rest.isEmpty():
                more = cut(self.compare(rest)).where(self.linked()).select("a", "b")
                label = components(links.unionByName(more))
        # From the classes' names to their smallest doc_id.
        joined = label.join(reps, "id")
        least = joined.groupBy("component").agg(F.min("rep").alias("least"))
        label = joined.join(least, "component").select(F.col("id").alias("_id"), F.col("component").alias("root"), "least")
        found = reps.join(label, reps.id == F.col("_id"), "left")
        return narrow, cut(found.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("least", "rep").alias("component")))

    def linked(self) -> str:
        return f"100 * both >= {self.percent} * (na + nb - both)"

    def screen(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with sizes, without those that can't come near."""
        one, two = (self.sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        close = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {near_percent(self.percent)} * greatest(na, nb) and {_equal_nibbles('sa', 'sb')} >= {least_equal(near_percent(self.percent), 5.0)}")
        return close.select("a", "b", "na", "nb")

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) with their sets xa and xb. The set of an a with many pairs goes out in several copies, one
        for each PART pairs, so no task gets more than PART pairs of one a."""
        parts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
        dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
        one = self.sets.join(parts, self.sets.id == parts.a).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("xa"))
        two = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
        return dealt.join(two, "b").join(one, ["a", "part"]).drop("part")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, both) with the size of the intersection of the full sets."""
        full = self.with_sets(cut(self.screen(pairs)))
        return full.select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).cast("long").alias("both"))

    def differences(self, pairs: DataFrame, label: DataFrame) -> DataFrame:
        """(group, id, c, nl, n, lacks, d) of the groups that aren't settled yet: for each class, its component so far,
        how many shingles of the group's leader it lacks, and all in which the two differ."""
        name = lambda key, c: label.select(F.col("id").alias(key), F.col("component").alias(c))
        state = pairs.join(name("leader", "_g"), "leader", "left").join(name("id", "_c"), "id", "left")
        state = cut(state.select("leader", "id", F.coalesce("_g", "leader").alias("group"), F.coalesce("_c", "id").alias("c")))
        # A group is settled if all that was compared with its leaders is in one component.
        first = state.groupBy("group", "leader").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
        first = first.groupBy("group").agg(F.max(F.struct("n", "leader")).alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
        first = cut(first.where("low <> high").select("group", F.col("m.leader").alias("a")))
        rows = state.select("group", "id", "c").distinct().join(first, "group").where("id <> a")
        full = self.with_sets(cut(rows.select("a", F.col("id").alias("b"), "group", "c")))
        lacks, has = F.array_except("xa", "xb"), F.array_except("xb", "xa")
        return full.select("a", "group", F.col("b").alias("id"), "c", F.size("xa").alias("nl"), F.size("xb").alias("n"), F.size(lacks).alias("lacks"), F.concat(lacks, has).alias("d"))

    def left_over(self, pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes of one group and two components that may be linked."""
        p = self.percent
        rows = cut(self.differences(pairs, label))
        # What a class shares at least with an outsider, which isn't linked to the leader, and with any other class.
        far = f"greatest(1, ceil(({p}L * (n - nl) + {100 + p}L * lacks) / {100 + p}))"
        size = f"least(greatest(nl, ceil({p} * n / 100)), floor(100 * n / {p}))"
        any_ = f"greatest(1, ceil(({p}L * (n + {size}) - {100 + p}L * (nl - lacks - greatest(0, nl - {size}))) / {100 + p}))"
        rows = rows.select("a", "group", "id", "c", "nl", "n", "lacks", "d", F.size("d").alias("s"), F.expr(far).cast("long").alias("far"), F.expr(any_).cast("long").alias("any"))
        # An outsider that is linked to the leader after all.
        direct = rows.where(f"c <> group and {100 + p}L * (nl - lacks) >= {p}L * (nl + n)").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        outside = rows.where("c <> group")
        often = cut(outside.select("group", F.explode("d").alias("e")).groupBy("group", "e").agg(F.count("*").alias("f")))
        small = F.broadcast(often) if often.count() <= MOST_BROADCAST // 16 else often
        common = rows.select("group", "id", F.explode("d").alias("e")).join(small, ["group", "e"]).groupBy("group", "id").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("common"))
        rows = cut(rows.drop("d", "a").join(common, ["group", "id"]))
        # A class's differences in order of rarity: those that no outsider has come first, and can't be shared with one.
        rows = rows.withColumn("common", F.expr("transform(common, (v, k) -> struct(v.e as e, cast(s - size(common) + k as long) as at))"))

        def prefix(need: str) -> DataFrame:
            at = F.explode(F.expr(f"filter(common, v -> v.at <= s - {need})")).alias("v")
            return rows.select("group", "id", "c", "nl", "n", "lacks", "s", at).select("group", "id", "c", "nl", "n", "lacks", "s", "v.e", "v.at")

        y, x = prefix("any").where("c <> group").alias("y"), prefix("far").alias("x")
        # Times (100 + p): how many differences x and y share if they are linked.
        least = f"{p}L * (x.n + y.n) - {100 + p}L * (x.nl - x.lacks - y.lacks)"
        able = f"{100 + p}L * least(x.s - x.at, y.s - y.at) >= {least} and 100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n)"
        found = y.join(x, F.expr(f"x.group = y.group and x.e = y.e and x.c <> y.c and (x.c = x.group or y.id < x.id) and {able}"))
        return found.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).unionByName(direct).distinct()


def _judged(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, row_text, n, root, component) of each row of docs (doc_id, text, row_text)."""
    rows, found = _Linker(docs.select("doc_id", "text", "row_text"), percent, width).classes()
    rows = rows.join(found, "id", "left")
    # An empty text, and a row without doc_id, is a component of its own.
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "row_text", "n", "root", F.when(F.col("doc_id").isNotNull(), component).alias("component"))


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept. Links: 100 * shared >= percent * all."""
    rows = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_text")), percent, width)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Of each component the row with the smallest doc_id, all columns of docs. Where a doc_id repeats, rows that are
    alike count as one, and of the texts of a component's smallest doc_id the one with the smallest hash stays. A row
    without shingles, or without doc_id, is a component of its own."""

    def state(rows: DataFrame) -> DataFrame:
        found = _judged(rows, percent, width)
        first = found.where("component = doc_id and n > 0").groupBy("root").agg(F.min("row_text").alias("first"))
        kept = F.col("component").isNull() | (F.col("n") == 0) | (F.col("component") == F.col("doc_id")) & (F.col("row_text") == F.col("first"))
        return found.join(cut(first), "root", "left").select(F.col("doc_id").alias("row_id"), "row_text", F.coalesce(kept, F.lit(False)).alias("kept"))

    return keep_rows(docs, state)
