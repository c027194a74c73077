"""Selection without a sort of the whole table: the first n rows by a key, and exact quantiles.

Both count rows in the bins of a histogram, keep the bins in which a wanted place lies, and count again inside these.
The driver sees a bounded number of bins in each round, no task holds a group, and nothing is estimated: a round
ends a search when its bin holds one value only.
"""

from __future__ import annotations

import functools
import math
import operator
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered, settled

#: Bits of a key that a round settles, and rows of a bin whose keys are looked at one by one.
STEP_BITS, FEW = 12, 4096
#: Bins of all open ranges in one round, and bins of one range.
MOST_BINS, BINS = 1 << 20, 1024
#: A group of so many rows at most is sorted in memory; so many larger ones are searched together.
SMALL, MOST_GROUPS = 4096, 1000


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def first_by(rows: DataFrame, key: Column, wanted: dict, by: str | None = None, tie: list[Column] | None = None, bits: int = 60) -> DataFrame:
    """Of each value of `by` (few; without it, {None: n}), the first wanted[value] rows in order of key, which has so many
    bits, then of tie. rows is read some three times. Values that aren't wanted, and null keys, are left out."""
    named, cut, is_ = _cuts(rows, key, wanted, by, bits)
    out = named.where(_any([is_(v) & (F.col("_key") < k) for v, (k, _) in cut.items()]))
    for v, (k, rest) in cut.items():
        if rest:
            same = numbered(named.where(is_(v) & (F.col("_key") == k)), tie or [F.col(c) for c in rows.columns], "_place")
            out = out.unionByName(same.where(F.col("_place") < rest).drop("_place"))
    return out.drop("_key")


def marked_first(rows: DataFrame, key: Column, wanted: dict, by: str, tie: list[Column], name: str, yes: str, no: str, bits: int = 60) -> DataFrame:
    """All rows, with name: `yes` for those of first_by(), `no` for others. No row is moved, but for those at a cut."""
    named, cut, is_ = _cuts(rows, key, wanted, by, bits)
    first = F.col("_key") < F.coalesce(*(F.when(is_(v), F.lit(k)) for v, (k, _) in cut.items()), F.lit(0))
    tied = _any([is_(v) & (F.col("_key") == k) for v, (k, rest) in cut.items() if rest])
    out = named.where(~F.coalesce(tied, F.lit(False))).withColumn(name, F.when(first, yes).otherwise(no))
    for v, (k, rest) in cut.items():
        if rest:
            same = numbered(named.where(is_(v) & (F.col("_key") == k)), tie, "_place")
            out = out.unionByName(same.withColumn(name, F.when(F.col("_place") < rest, yes).otherwise(no)).drop("_place"))
    return out.drop("_key")


def _cuts(rows: DataFrame, key: Column, wanted: dict, by: str | None, bits: int):
    """rows with _key; of each value of `by` the key below which all rows are wanted, and how many of those with that key;
    and the condition for a value."""
    named = rows.withColumn("_key", key)
    is_ = lambda v: F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(v))
    # Of each value: rows with a key below `low` are in, and `left` of those from there on.
    low, left = dict.fromkeys(wanted, 0), dict(wanted)
    cut: dict = {v: (0, 0) for v, n in wanted.items() if n <= 0}
    shift = bits
    while len(cut) < len(wanted):
        span, shift = shift, max(0, shift - STEP_BITS)
        within = lambda v, span=span: is_(v) & (F.col("_key") >= low[v]) & (F.col("_key") < low[v] + (1 << span))
        values = [v for v in wanted if v not in cut]
        at = F.coalesce(*(F.when(within(v), F.shiftright(F.col("_key") - low[v], shift)) for v in values))
        which = F.coalesce(*(F.when(within(v), F.lit(k)) for k, v in enumerate(values)))
        found = defaultdict(list)
        for r in named.where(_any([within(v) for v in values])).groupBy(which.alias("k"), at.alias("at")).count().collect():
            found[values[r.k]].append((r["at"], r["count"]))
        few = []
        for v in values:
            for b, n in sorted(found[v]):
                if n > left[v]:
                    low[v] += b << shift
                    if n <= FEW or shift == 0:
                        few.append(v)
                    break
                left[v] -= n
                if not left[v]:
                    cut[v] = (low[v] + (b + 1 << shift), 0)
                    break
            else:
                # There are no more rows than wanted.
                cut[v] = (low[v] + (1 << span), 0)
        if few and shift == 0:
            cut |= {v: (low[v], left[v]) for v in few}
        elif few:
            last = lambda v, shift=shift: is_(v) & (F.col("_key") >= low[v]) & (F.col("_key") < low[v] + (1 << shift))
            keys = defaultdict(list)
            for r in named.where(_any([last(v) for v in few])).select(F.coalesce(*(F.when(last(v), F.lit(k)) for k, v in enumerate(few))).alias("k"), "_key").collect():
                keys[few[r.k]].append(r["_key"])
            for v in few:
                own = sorted(keys[v])
                # Rows that share the key at the cut are told apart by tie.
                at_cut = own[left[v]]
                cut[v] = (at_cut, left[v] - sum(k < at_cut for k in own))
    return named, cut, is_


def first_n(rows: DataFrame, key: Column, n: int, tie: list[Column] | None = None, bits: int = 60) -> DataFrame:
    """The first n rows in order of key, then of tie."""
    return first_by(rows, key, {None: n}, None, tie, bits)


def quantiles(rows: DataFrame, value: str, points: list[float] | tuple[float, ...], *keys: str, small: int = SMALL) -> DataFrame:
    """keys and quantiles, an array: for each point p between 0 and 1 the value at place p * (n - 1) in order, between
    two places by linear interpolation. Without keys one row, without rows null. Null values don't count; others must
    be finite. rows is read once for each round, some four times."""
    if not points or any(not 0 <= p <= 1 for p in points):
        raise ValueError("points must be between 0 and 1")
    plain = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    sizes = settled(plain.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.min(F.abs("_v") < float("inf")).alias("_finite")))
    if not sizes.where("_n > 0 and not _finite").isEmpty():
        raise ValueError(f"{value} must be finite")
    same = lambda side: functools.reduce(operator.and_, (F.col(k).eqNullSafe(side[f"_{k}"]) for k in keys), F.lit(True))
    schema = plain.select(*keys, F.lit(None).cast("array<double>").alias("quantiles")).schema
    few = sizes.where(F.col("_n") <= small).select(*(F.col(k).alias(f"_{k}") for k in keys))
    found = []
    held = plain.join(few, same(few), "left_semi") if keys else plain
    if keys or not few.isEmpty():
        found.append(held.groupBy(*keys).agg(F.percentile("_v", list(points)).alias("quantiles")))
    batch = []
    for group in sizes.where(F.col("_n") > small).toLocalIterator():
        batch.append(group)
        if len(batch) == MOST_GROUPS:
            found.append(_searched(plain, points, keys, batch, schema))
            batch = []
    if batch:
        found.append(_searched(plain, points, keys, batch, schema))
    return functools.reduce(DataFrame.unionByName, found)


def _searched(plain: DataFrame, points, keys: tuple[str, ...], groups: list, schema) -> DataFrame:
    """The quantiles of some large groups."""
    spark = plain.sparkSession
    ranks = [sorted({f(p * (g["_n"] - 1)) for p in points for f in (math.floor, math.ceil)}) for g in groups]
    known: dict[tuple[int, int], float] = {}
    # Open searches: group, lowest and highest value of the range, rows of the group before it; and the places in it.
    ranges = {(k, g["_low"], g["_high"], 0): ranks[k] for k, g in enumerate(groups)}
    names = [f"_{k}" for k in keys]
    kinds = ", ".join(["_range int", "_low double", "_high double", "_one int", *(f"`_{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])])
    while ranges := {r: wanted for r, wanted in ranges.items() if not _closed(r, wanted, known)}:
        spans = list(ranges)
        bins = max(2, min(BINS, MOST_BINS // len(spans)))
        table = spark.createDataFrame([(i, low, high, 1, *(groups[k][c] for c in keys)) for i, (k, low, high, _) in enumerate(spans)], kinds)
        on = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)), F.lit(1) == F.col("_one")) if keys else F.col("_all") == F.col("_one")
        rows = plain.withColumn("_all", F.lit(1)).join(F.broadcast(table), on).where("_v between _low and _high")
        # Halves, since the width of a range may be more than a double holds.
        at = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins).cast("int"))
        counted = defaultdict(list)
        for r in rows.groupBy("_range", at.alias("_bin")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect():
            counted[r["_range"]].append((r["_bin"], r["n"], r["low"], r["high"]))
        narrower: dict = defaultdict(list)
        for i, (k, _, _, before) in enumerate(spans):
            wanted = ranges[spans[i]]
            for _, n, low, high in sorted(counted[i]):
                if inside := [w for w in wanted if before <= w < before + n]:
                    narrower[(k, low, high, before)] += inside
                before += n
        ranges = narrower
    out = []
    for k, g in enumerate(groups):
        values = []
        for p in points:
            at = p * (g["_n"] - 1)
            a, b = known[k, math.floor(at)], known[k, math.ceil(at)]
            values.append(a if a == b else a * (math.ceil(at) - at) + b * (at - math.floor(at)))
        out.append((*(g[c] for c in keys), values))
    return spark.createDataFrame(out, schema)


def _closed(span: tuple, wanted: list[int], known: dict) -> bool:
    """A range of one value answers its places."""
    if span[1] == span[2]:
        known |= {(span[0], w): span[1] for w in wanted}
        return True
    return False


def with_quantiles(stats: DataFrame, rows: DataFrame, value: str, points: list[float] | tuple[float, ...], *keys: str, name: str = "p") -> DataFrame:
    """stats, one row for each value of keys, with the quantiles of rows as the array `name`."""
    found = quantiles(rows, value, points, *keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("quantiles").alias(name))
    if not keys:
        return stats.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return stats.join(found, functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys))


def percentile(rows: DataFrame, value: str, q: float, empty: float | None = None) -> float:
    """One percentile, q between 0 and 100, of a whole column. An empty one is an error, or `empty` where that is given."""
    if not 0 <= q <= 100:
        raise ValueError("a percentile is between 0 and 100")
    row = quantiles(rows, value, [q / 100]).first()
    if row is None or row.quantiles is None:
        if empty is None:
            raise ValueError(f"no percentile of an empty column: {value}")
        return empty
    return row.quantiles[0]
