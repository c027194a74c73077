"""URL filtering by a cascade of Bloom filters.

The universe is every key that a URL of the corpus can be listed under: a suffix of its host's labels with a
prefix of its path. Level 0 holds the listed keys. Level 1 holds the keys of the universe that are not listed
and still pass level 0, level 2 the listed keys that pass level 1, and so on by turns until none is left over.
A key is then listed exactly if the first level that it fails is an odd one (or the last level that it passes
is an even one), with no error for any key of the universe and no join. Level 0 is sized so that about as many
other keys pass it as there are listed keys, so the later levels are as small as the list, not as the corpus.

Each verdict has a cascade of its own, which is all that goes to the executors: the first (longest) key of a URL that one
of them lists is its rule, and says itself which rule that is.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed, as is
every URL that fits no rule (the method's verdict for keys that aren't listed). Rows that repeat are judged one
by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mixed

#: (verdict, host, path): the rules of the production query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Of all levels of a cascade together; a longer list is an error, not a larger broadcast.
MOST_BITS = 1 << 31
LEVELS = 40


@dataclass
class Bloom:
    """A Bloom filter over 64-bit hashes."""

    salt: int
    n_bits: int
    n_hashes: int
    words: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, hashes: np.ndarray, rate: float, salt: int) -> Bloom:
        n = max(1, len(hashes))
        n_bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
        if n_bits > MOST_BITS:
            raise ValueError(f"{n} listed keys need a filter of {n_bits} bits; the limit is {MOST_BITS}")
        out = cls(salt, n_bits, max(1, round(n_bits / n * math.log(2))), np.zeros(n_bits // 64, np.uint64))
        for bit in out._bits(hashes):
            np.bitwise_or.at(out.words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        return out

    def _bits(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        a = mixed(hashes + np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        b = mixed(a) | np.uint64(1)
        for k in range(self.n_hashes):
            yield (a + np.uint64(k) * b) % np.uint64(self.n_bits)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for bit in self._bits(hashes):
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def listed(levels: list[Bloom], hashes: np.ndarray) -> np.ndarray:
    """Which keys are listed; exact for the keys of the universe that the cascade was built over."""
    out, alive = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    for k, level in enumerate(levels):
        ask = np.flatnonzero(alive)
        ok = level.passes(hashes[ask])
        out[ask] = ok if k % 2 == 0 else ~ok
        alive[ask[~ok]] = False
    return out


def parts(url: str = "url"):
    """Host (A-Z lower-cased) and path of a URL, as columns."""
    has = F.instr(F.col(url), "://") > 0
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def keys_of(lengths: list[int]):
    """All keys of (host, path) as a column: suffixes of the host's labels with path prefixes of the lengths that
    rules have. Longest keys first."""
    labels = "split(host, '[.]')"
    suffixes = f"transform(sequence(1, size({labels})), i -> concat_ws('.', slice({labels}, i, size({labels}))))"
    prefixes = f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> substring(path, 1, n))"
    pairs = f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> struct(length(h) + length(p) as n, concat(h, p) as k))))"
    return F.expr(f"case when host = '' then cast(array() as array<string>) else transform(array_sort({pairs}, (a, b) -> b.n - a.n), x -> x.k) end")


def _key_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), column.offsets.to_numpy()


def build_cascades(universe: DataFrame, lists: list[np.ndarray]) -> list[list[Bloom]]:
    """universe: rows with hashes (array of the 64-bit hashes of a URL's keys); lists: the hashes of listed keys. A
    cascade for each list, from one pass over the universe's keys."""
    lists = [np.unique(x) for x in lists]
    total = max(1, universe.select(F.sum(F.size("hashes"))).first()[0] or 0)
    first = [Bloom.of(x, min(0.5, max(1e-12, max(1, len(x)) / (math.sqrt(2) * total))), 0) for x in lists]
    sent = universe.sparkSession.sparkContext.broadcast(first)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(_key_hashes(batch.column(0))[0])
            found = [h[level.passes(h)] for level in sent.value]
            which = np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate(found).view(np.int64))], ["which", "h"])

    # What passes level 0: listed keys, and about as many others. Each partition drops repeats before they are shuffled.
    passed = map_arrow(universe.select("hashes"), pick, "which int, h long").distinct().toArrow()
    sent.destroy()
    which, h = passed["which"].to_numpy(), passed["h"].to_numpy().view(np.uint64)
    return [_cascade(level, wanted, np.setdiff1d(h[which == k], wanted)) for k, (level, wanted) in enumerate(zip(first, lists))]


def _cascade(first: Bloom, named: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """named: the listed keys; others: the keys of the universe that aren't listed and pass the first level."""
    levels = [first]
    while len(levels) < LEVELS:
        # Odd levels hold the other keys that are still left, even ones the listed keys that pass those.
        fresh, against = (others, named) if len(levels) % 2 else (named, others)
        if not len(fresh):
            return levels
        levels.append(Bloom.of(fresh, 0.5, len(levels)))
        left = against[levels[-1].passes(against)]
        others, named = (others, left) if len(levels) % 2 == 0 else (left, named)
    raise ValueError("the cascade doesn't end")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    spark = pages.sparkSession
    host, path = parts()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = keys_of(sorted({len(p) for _, _, p in rules}))
    rows = rows.withColumn("hashes", F.transform(keys, lambda k: F.xxhash64(k)))
    names = sorted({v for v, _, _ in rules})
    table = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, k string")
    held = table.select("verdict", F.xxhash64("k").alias("x")).toArrow()
    lists = [held.filter(pa.compute.equal(held["verdict"], v))["x"].to_numpy().view(np.uint64) for v in names]
    cascades = spark.sparkContext.broadcast(build_cascades(rows, lists))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = _key_hashes(batch.column("hashes"))
            base, h = offsets[0], h[offsets[0] : offsets[-1]]
            found = np.stack([listed(levels, h) for levels in cascades.value])
            yes = np.flatnonzero(found.any(0))
            # The first listed key of each row is its longest.
            row = np.searchsorted(offsets - base, yes, "right") - 1
            row, first = np.unique(row, return_index=True)
            at, verdict = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, "allow", object)
            at[row] = yes[first] - (offsets[row] - base) + 1
            verdict[row] = np.array(names, object)[found[:, yes[first]].argmax(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(at), pa.array(verdict, pa.string())], ["page_id", "host", "path", "at", "verdict"])

    judged = map_arrow(rows.select("page_id", "host", "path", "hashes"), judge, rows.select("page_id", "host", "path").schema.add("at", "integer").add("verdict", "string"))
    return judged.select("page_id", "host", "path", F.when(F.col("at") > 0, F.element_at(keys, F.col("at"))).alias("rule"), "verdict")
