"""Phrases that are more frequent than their parts lead one to expect, mined with suffix automata.

A shard is the texts of some MB. The states of its generalised suffix automaton are the classes of phrases that end at the
same places, its suffix links the tree of those classes: the trie of all contexts read backwards, with unary paths in one.
Bounded to a depth, this tree comes from sorting the words' places by their last words, and a state's number of places is
its run in that order. A state gives its phrases (the longest, and how short they get) with one count; counts are summed
over the shards.

Only phrases whose every part is frequent can be frequent, so passes over the texts widen the automata by a word each: words
alone, pairs of frequent words, phrases of three whose pairs are frequent, and so on, all counted by hash. What is frequent
goes out as a bitmap of hashes, which never misses one. A last pass counts the phrases that are left by their text, which is
exact: what a bitmap lets through beside fails the threshold there.

A candidate is subsumed by a longer one that contains it and is about as frequent. Each longer candidate tells its count
along its suffix links and along those of its prefixes, which together name every phrase in it.

Defined results: null and empty texts have no words, a null language is `und`. All phrases of a language count alike
whatever document they are in, so null and repeated doc_ids make no difference and a row that repeats counts again. Ties
are ordered by phrase. An empty table, and a language without candidates, gives no rows. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, IdFilter, cut, join_unique, map_arrow, mixed, prefix_hash, row_blocks, shuffle_size, span_hash, table, text_bytes, words

#: Bytes that end a piece: `[.,;:!?\x0A-\x0D]`, and bytes of words: all but those, space and tab.
ENDS_PIECE = table(lambda b: b in b".,;:!?\n\v\f\r")
IN_WORD = table(lambda b: b not in b".,;:!?\n\v\f\r \t")
SHARD_BYTES = 4 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """The words of some texts. word: number of each one (of one language) in `known`; reach: how many words the longest
    phrase of interest has that ends with it; name: a hash of each known word and its language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array, longest: int):
        data = LOWER[data]
        starts, ends = words(data, offsets, IN_WORD)
        row = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(ENDS_PIECE[data], dtype=np.int32)[starts] if len(data) else starts
        first = np.ones(len(starts), bool)
        first[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
        at = np.arange(len(starts))
        self.longest, self.reach = longest, np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)) + 1, longest)
        body = np.ascontiguousarray(data[IN_WORD[data]])
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
        langs = langs.dictionary_encode()
        self.langs, n = langs.dictionary, max(1, len(langs.dictionary))
        of_lang = langs.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64) if len(row) else row
        known, self.word = np.unique(found.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + of_lang, return_inverse=True)
        self.text, self.lang = found.dictionary.take(pa.array(known // n)), known % n
        raw, offsets = text_bytes(self.text)
        lang_raw, lang_at = text_bytes(self.langs)
        own = span_hash(prefix_hash(lang_raw), lang_at[:-1], lang_at[1:])
        self.name = mixed(span_hash(prefix_hash(raw), offsets[:-1], offsets[1:]) * STEP + own[self.lang]) if len(known) else np.zeros(0, np.uint64)

    def names(self, last: np.ndarray, length: int) -> np.ndarray:
        """A hash of the phrase of that many words that ends at each place."""
        out = self.name[self.word[last - length + 1]]
        for k in range(length - 2, -1, -1):
            out = mixed(out * STEP + self.name[self.word[last - k]])
        return out

    def keep(self, length: int, frequent: IdFilter) -> None:
        """Ends the reach of what holds a phrase of that length that isn't frequent."""
        last = np.flatnonzero(self.reach >= length)
        if length == 1:
            found = frequent.probably(pa.array(self.name.view(np.int64)))[self.word]
        else:
            found = frequent.probably(pa.array(self.names(last, length).view(np.int64)))
        self.reach[last[~found]] = length - 1
        for _ in range(self.longest - 1):
            # A phrase reaches one word further back than what it is without its last word.
            self.reach[1:] = np.minimum(self.reach[1:], self.reach[:-1] + 1)

    def states(self, depth: int, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The states of the automaton over phrases of up to depth words within reach, that end where `least` words are. For
        each length of a state's longest phrase: that length, where one of them ends, how short its phrases get, and how
        often they come."""
        n = np.int64(len(self.name) + 1)
        among = np.flatnonzero(self.reach >= least)
        reach = self.reach[among]
        before = [np.where(reach > k, self.word[among - k] + 1, 0) for k in range(depth)]
        # Two words in one number.
        keys = [before[k] * n + (before[k + 1] if k + 1 < depth else 0) for k in range(0, depth, 2)]
        order = np.lexsort(keys[::-1])
        before, size = [b[order] for b in before], len(order)
        new, runs = np.zeros(size, bool), []
        if size:
            new[0] = True
        for b in before:
            new = new.copy()
            new[1:] |= b[1:] != b[:-1]
            first = np.flatnonzero(new)
            end = np.zeros(size, np.int64)
            end[first] = np.append(first[1:], size)
            # Phrases of this length: end is 0 where none begins, or where the piece is shorter.
            end[b == 0] = 0
            runs.append(end)
        for k in range(depth - 1, -1, -1):
            longest = runs[k] > 0
            if k + 1 < depth:
                longest &= runs[k + 1] != runs[k]
            at = np.flatnonzero(longest)
            least = np.full(len(at), k + 1)
            for j in range(k - 1, -1, -1):
                # The shorter phrase comes at the same places, so it is of this state.
                least[(runs[j][at] == runs[k][at]) & (least == j + 2)] = j + 1
            yield k + 1, among[order[at]], least, runs[k][at] - at


def _shards(batches: Iterator[pa.RecordBatch], longest: int, filters: list) -> Iterator[Shard]:
    """Shards of the texts of a task, their reach ended by the filters of phrases of 1, 2, ... words."""
    held, size = [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        for a, b in row_blocks(offsets, SHARD_BYTES):
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= SHARD_BYTES:
                yield _shard(held, longest, filters)
                held, size = [], 0
    if held:
        yield _shard(held, longest, filters)


def _shard(held: list[pa.RecordBatch], longest: int, filters: list) -> Shard:
    rows = pa.Table.from_batches(held)
    shard = Shard(*text_bytes(rows["text"].cast(pa.large_string())), rows["lang"].combine_chunks(), longest)
    for length, known in enumerate(filters, 1):
        shard.keep(length, known.value)
    return shard


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches, 1, []):
        for _, last, _, n in shard.states(1):
            word = shard.word[last]
            yield pa.RecordBatch.from_arrays([shard.langs.take(pa.array(shard.lang[word])), pa.array(shard.name[word].view(np.int64)), pa.array(n)], ["lang", "key", "n"])


def _counter(length: int, filters: list) -> Callable:
    """Counts phrases of one length by their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, length, filters):
            for k, last, _, n in shard.states(length, length):
                if k == length:
                    yield pa.RecordBatch.from_arrays([pa.array(shard.names(last, length).view(np.int64)), pa.array(n)], ["key", "n"])

    return count


def _phrase_counter(longest: int, filters: list) -> Callable:
    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, longest, filters):
            for length, last, least, n in shard.states(longest):
                phrase = shard.word[last[:, None] + np.arange(1 - length, 1)]
                text = pa.ListArray.from_arrays(pa.array(np.arange(len(last) + 1, dtype=np.int32) * length), shard.text.take(pa.array(phrase.ravel())).cast(pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([shard.langs.take(pa.array(shard.lang[shard.word[last]])), text, pa.array(least.astype(np.int32)), pa.array(n)], ["lang", "words", "least", "n"])

    return count_phrases


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to `longest` words that come `least` times or more, words among them,
    and (lang, n): how many words a language has."""
    spark = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    known = cut(map_arrow(rows, count_words, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    total = known.groupBy("lang").agg(F.sum("n").alias("n"))
    filters = [spark.broadcast(IdFilter.of(known.where(F.col("n") >= least), "key"))]
    for length in range(2, longest + 1):
        counted = map_arrow(rows, _counter(length, list(filters)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        filters.append(spark.broadcast(IdFilter.of(cut(counted.where(F.col("n") >= least).select("key")), "key")))
    states = map_arrow(rows, _phrase_counter(longest, filters), "lang string, words array<string>, least int, n long")
    phrase = F.expr("array_join(slice(words, size(words) - length + 1, length), ' ')")
    each = states.select("lang", "words", "n", F.explode(F.sequence("least", F.size("words"))).alias("length")).select("lang", phrase.alias("phrase"), "length", "n")
    return cut(each.groupBy("lang", "phrase", "length").agg(F.sum("n").alias("f")).where(F.col("f") >= least)), total


def _part(start, length) -> F.Column:
    return F.array_join(F.slice("w", start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases (lang, phrase, length, f) of two words or more, by their worst cut."""
    w = phrases.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    w = w.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("part"))))
    asked = cut(w.select("lang", "phrase", "a", "k", sides.alias("s")).select("phrase", "a", "k", "s.side", F.struct("lang", F.col("s.part").alias("phrase")).alias("key")))
    told = join_unique(asked, phrases.select(F.struct("lang", "phrase").alias("key"), "f"), "key")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cuts = told.groupBy(F.col("key.lang").alias("lang"), "phrase", "a", "k").agg(side("l"), side("r"))
    score = F.expr("cast(cast(2000000 as decimal(7)) * cast(a as decimal(20)) div (cast(l as decimal(20)) + cast(r as decimal(20))) as long)")
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(worst.alias("b")).select("lang", "phrase", "a", "b.*")


def subsumed(phrases: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of the phrases in a longer one that has `share` percent of their occurrences or more."""
    longer = phrases.where("length > 2").select("lang", "length", "f", F.split("phrase", " ").alias("w"))
    # A prefix, the whole included, and the suffix links from it.
    longer = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("length"))).alias("end"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("end"))).alias("size")).where("size < length")
    most = longer.groupBy("lang", _part(F.col("end") - F.col("size") + 1, F.col("size")).alias("phrase")).agg(F.max("f").alias("within"))
    wide = lambda c: F.col(c).cast("decimal(20)")
    return phrases.join(most, ["lang", "phrase"]).where(wide("within") * 100 >= wide("f") * share).select("lang", "phrase")


def first_of_each(rows: DataFrame, key: str, n: int, *order) -> DataFrame:
    """The first n of each key with their rank. Each of several buckets of a key sends its own first n at most."""
    bucket = F.pmod(F.xxhash64(*rows.columns), F.lit(shuffle_size(rows.sparkSession)))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    few = rows.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(inside)).where(F.col("_rank") <= n).drop("_rank", "_bucket")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, total = frequent_phrases(docs, least, longest)
    kept = scored(phrases).join(subsumed(phrases, share), ["lang", "phrase"], "left_anti")
    ranked = first_of_each(kept, "lang", top, F.desc("score"), F.desc("a"), F.asc("phrase"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
