"""A Merkle manifest of a dataset: a leaf for each row, a tree for each language, and a tree over the languages.

H is lowercase hex SHA-256 of its inputs one after another. A leaf is H of doc_id, source, lang, n_chars and text, each `-`
if null, else its UTF-8 byte count, `:` and its value. Within a tree the nodes of a level stand in order, and every ARITY
consecutive ones (the last run may be shorter, even one) become their H, until one is left.

Levels are windows: nodes are partitioned by tree and parent index, and an ordered collect_list over the full frame gives
each run's digests, which are the parent's preimage and each member's siblings at once. Of a run's rows one goes on as
the parent, so each level has half the rows of the one below. Rows are dealt by tree and block, a block being a subtree of
LEVELS levels: its windows nest in that dealing and need no shuffle of their own. A node carries what it stands for, at
most ARITY ** LEVELS leaves with their siblings so far; then the blocks are written and become the next round's leaves.
At 10**10 rows that is five rounds, each over 256 times fewer rows than the one before. Only digests move, never texts.

Defined results: rows stand by doc_id within their language, a null doc_id first; rows that repeat a doc_id by their
leaves, and rows alike in both are interchangeable, each with a place and a proof of its own. A null language is a tree
of its own and the first one. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, join_unique

ARITY = 2
#: Levels that are climbed in one round.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, counted from 0 in that order, ties in any. A range-partitioned sort that is checkpointed, so that
    a place stays what it is; offsets are sums over the partitions' counts."""
    tie = F.monotonically_increasing_id()
    ranked = cut(rows.withColumn("_tie", tie).sort(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # As many rows as partitions.
    counts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranked.join(F.broadcast(offsets), part == F.col("_part")).withColumn("place", F.col("_before") + inside).drop("_at", "_part", "_before")


def climb(nodes: DataFrame, most: int, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, i, n, digest, item): the i-th of the n leaves of a tree, at most `most`, and any struct that it stands
    for. Gives (tree, root, item, path) for each: the siblings before and after it at each level, up to the root."""
    height, rest = 0, most
    while rest > 1 and height < levels:
        height, rest = height + 1, -(-rest // arity)
    step = nodes.select("tree", F.floor(F.col("i") / arity**height).cast("long").alias("block"), "i", "n", "digest", F.array(F.struct("item", F.array().cast(PATH).alias("path"))).alias("members"))
    step = step.repartition("tree", "block")
    for _ in range(height):
        # A tree of one node is done; its node stays as it is.
        parent, more = F.floor(F.col("i") / arity).cast("long"), F.col("n") > 1
        step = step.withColumn("parent", parent)
        run = Window.partitionBy("tree", "block", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        step = step.withColumn("run", F.collect_list(F.struct("digest", "members")).over(run))
        step = step.where(F.col("i") == F.col("parent") * arity)
        told = F.expr("""flatten(transform(run, (node, k) -> transform(node.members, m -> struct(m.item as item,
            concat(m.path, array(struct(array_join(transform(slice(run, 1, k), x -> x.digest), '') as before,
                                        array_join(transform(slice(run, k + 2, size(run)), x -> x.digest), '') as after))) as path))))""")
        step = step.select("tree", "block", F.col("parent").alias("i"), F.when(more, F.ceil(F.col("n") / arity)).otherwise(F.col("n")).cast("long").alias("n"), F.when(more, F.sha2(F.expr("array_join(run.digest, '')"), 256)).otherwise(F.col("digest")).alias("digest"), F.when(more, told).otherwise(F.col("members")).alias("members"))
    blocks = cut(step.select("tree", "block", "n", "digest", "members"))
    if rest <= 1:
        return blocks.select("tree", F.col("digest").alias("root"), F.explode("members").alias("m")).select("tree", "root", "m.item", "m.path")
    upper = climb(blocks.select("tree", F.col("block").alias("i"), "n", "digest", F.struct("block").alias("item")), rest, arity, levels)
    upper = upper.select("tree", F.col("item.block").alias("block"), "root", F.col("path").alias("rest"))
    rows = blocks.select("tree", "block", "members").join(upper, ["tree", "block"])
    return rows.select("tree", "root", "rest", F.explode("members").alias("m")).select("tree", "root", "m.item", F.concat("m.path", "rest").alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row for each document: doc_id, leaf, path, subroot, root and changed, its leaf with one more in n_chars (null where
    n_chars is)."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("decimal(20,0)")
    own = lambda n: leaf(doc_id, F.col("source"), F.col("lang"), n, F.col("text"))
    rows = docs.select(doc_id.alias("doc_id"), "lang", own(n_chars).alias("leaf"), F.when(n_chars.isNotNull(), own(n_chars + 1)).alias("changed"))
    rows = placed(rows, F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("leaf"))
    trees = rows.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    trees = cut(placed(trees, F.asc_nulls_first("lang")).select(F.struct("lang").alias("key"), F.col("place").alias("tree"), "first", "n"))
    count, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    # The struct makes a null language a key like others.
    dealt = join_unique(rows.withColumn("key", F.struct("lang")), trees, "key")
    subtrees = cut(climb(dealt.select("tree", (F.col("place") - F.col("first")).alias("i"), "n", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "changed").alias("item")), most, arity, levels))
    roots = subtrees.groupBy("tree").agg(F.first("root").alias("digest"))
    top = climb(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), "digest", F.struct("tree").alias("item")), count, arity, levels)
    top = cut(top.select(F.col("item.tree").alias("tree"), F.col("root").alias("top"), F.col("path").alias("rest")))
    return join_unique(subtrees, top, "tree").select("item.*", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))


def verify(proofs: DataFrame, tampered: Column) -> DataFrame:
    """Rows of manifest() with proof_sha256, folded_root and verified; where `tampered` holds, the fold starts from
    the leaf that one more in n_chars gives."""
    start = F.when(tampered, F.coalesce("changed", "leaf")).otherwise(F.col("leaf"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    rows = proofs.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(start, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest checked after a change of every document whose crc32(doc_id) 7 divides."""
    return verify(manifest(docs), F.coalesce(crc_mod("doc_id", 7) == 0, F.lit(False)))
