"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a 60-bit hash of its doc_id. A source that is to give t words, of S it has, gives every
document floor(t / S) times and, once more, the documents below a hash threshold. The threshold is found from
histograms: sum words by source and 12-bit hash bucket, find the bucket in which the running sum passes the
budget, and refine that bucket alone by the next 12 bits, until a bucket holds one hash. No sort of documents
takes place, and a source's documents never meet in one task: each level is a sum with map-side partial sums.

Defined results: null text has no words; the null source is a source of its own and comes last; documents with
one hash (repeated doc_id) are taken together; an empty table gives an empty result; a source without words has
target 0. The document at the threshold is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
#: Up to so many sources, the table of a row for each source is broadcast; beyond, it is shuffled.
MOST_BROADCAST = 50_000
HASH_DIGITS = 15
LEVEL_DIGITS = 3


def _measures() -> list[tuple[str, Column]]:
    n_words = F.expr(r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)").cast("long")
    h = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS)
    return [("size", n_words), ("h", h)]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words `[^\\x20\\x09-\\x0D]+` of each text; h: hex digits of an MD5 of doc_id."""
    return docs.select("doc_id", "source", *(x.alias(n) for n, x in _measures()))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """Adds target to (source, source_size): weight * level, cut at most * source_size, where level is such that
    targets add up to share * all. Sources are capped in order of source_size / weight (water filling). There is
    one row for each source, so the windows without a key hold as many rows as there are sources."""
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(ordered) - 1) % len(weights)
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), place + 1))
    rows = rows.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left)
    # The first source that its share doesn't fill sets the level of all that follow.
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", F.round(target, 6).alias("target"))


def limits(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row for each source of sizes(): source, source_size, target, times, at, with_it. A document of hash h is
    taken `times` times, and once more if h < at, or h = at and with_it."""
    bins = rows.groupBy("source", F.substring("h", 1, LEVEL_DIGITS).alias("b")).agg(F.sum("size").alias("words"))
    goals = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    goals = goals.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = cut(goals.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    small = _sender(goals)
    # The boundary bucket of each source so far: its prefix, and the words that stand before it.
    edge = goals.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(HASH_DIGITS // LEVEL_DIGITS):
        inside = rows.where("size > 0").join(small(edge.select(F.col("source").alias("_s"), "prefix")), F.col("source").eqNullSafe(F.col("_s")) & F.col("h").startswith(F.col("prefix")))
        bins = inside.groupBy("source", F.substring("h", 1, LEVEL_DIGITS * (level + 1)).alias("b")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("b")
        bins = bins.withColumn("upto", F.sum("words").over(running))
        found = bins.alias("x").join(small(edge.select("source", "budget", "below").alias("e")), F.col("x.source").eqNullSafe(F.col("e.source")))
        found = found.where(F.col("below") + F.col("upto") > F.col("budget"))
        found = found.groupBy("e.source", "e.budget", "e.below").agg(F.min(F.struct("b", "upto", "words")).alias("f"))
        edge = found.select("source", "budget", F.col("f.b").alias("prefix"), (F.col("below") + F.col("f.upto") - F.col("f.words")).alias("below"), F.col("f.words").alias("words"))
        edge = cut(edge)
    # At the last level a bucket is one hash. It is taken if the budget is nearer to the sum with it.
    closer = (F.col("below") + F.col("words") - F.col("budget")) < (F.col("budget") - F.col("below"))
    edge = edge.select(F.col("source").alias("_e"), F.col("prefix").alias("at"), closer.alias("with_it"))
    goals = goals.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left")
    return cut(goals.select("source", "source_size", "target", "times", "at", "with_it"))


def _sender(goals: DataFrame):
    return F.broadcast if goals.count() <= MOST_BROADCAST else (lambda df: df)


def _times(h: str) -> Column:
    """How often a row with a hash and its source's limits is taken."""
    extra = F.when(F.col("_at").isNull(), F.lit(False)).otherwise((F.col(h) < F.col("_at")) | (F.col("_with_it") & (F.col(h) == F.col("_at"))))
    return F.col("_times") + extra.cast("int")


def _marked(goals: DataFrame) -> DataFrame:
    return goals.select(F.col("source").alias("_g"), "source_size", "target", F.col("times").alias("_times"), F.col("at").alias("_at"), F.col("with_it").alias("_with_it"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, taken, times."""
    rows = sizes(docs).persist(StorageLevel.MEMORY_AND_DISK)
    goals = limits(rows, weights, share)
    out = rows.join(_sender(goals)(_marked(goals)), F.col("source").eqNullSafe(F.col("_g"))).withColumn("times", _times("h"))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, each with its number (repeat: 1, 2).

    A row's own source and hash say how often it is taken, so rows of one doc_id in two sources are judged by their
    own source, and no join on doc_id is needed. A document without words, or not taken, is no row. An input column
    called repeat is replaced; other columns are kept, whatever their names."""
    rows = sizes(docs).persist(StorageLevel.MEMORY_AND_DISK)
    goals = limits(rows, weights, share)
    rows.unpersist()
    kept = [c for c in docs.columns if c.lower() != "repeat"]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col("source").alias("_source"), *(x.alias(f"_{n}") for n, x in _measures()))
    out = whole.join(_sender(goals)(_marked(goals)), F.col("_source").eqNullSafe(F.col("_g"))).withColumn("_times", _times("_h")).where("_times > 0 and _size > 0")
    out = out.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select("_row.*", "repeat")
