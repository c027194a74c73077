"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, back off from a word after the word before it
to the word, then to the word's first 6 and first 4 bytes, whose continuation counts are the distinct words that
begin so, and last to the word counts of the whole corpus, which both classes share. Every order takes an absolute
discount off its counts and hands that mass to the next. An expression that a class has hardly seen gets its
probability from its beginning and from those shared counts, alike in both models, so rare words cancel out of the
comparison. A class is modelled twice, with the usual discount below 1 and with one of STRONG_DISCOUNT, which leaves
nothing of counts that may be chance.

A text's evidence are its length-normalised log-likelihood ratios, over the whole text and over its most toxic
stretches of 1, 4 and 16 words, and how many words speak strongly for the toxic model; a logistic curve, fitted on
labelled rows that the counts left out, turns them into a probability. (A few toxic words hardly move the mean of a
long text: by the whole text's ratio alone a fifth of the toxic rows are found, see the README.)

Words, their beginnings and word pairs are named by 64-bit hashes, so none share a count. The corpus's counts are
rows, one for each distinct word of all documents, and stay distributed. Where neither class has a word (a beginning),
its shared count is the same factor of both probabilities and drops out of their ratio, so scoring needs the counts of
the labelled rows' words alone: they are looked up among the corpus's and go to the executors as sorted arrays. Their
size is bounded by that of the sample: MOST_LABELS rows, half of them of either class as far as there are so many, of at
most MOST_BYTES bytes (longer rows don't train), one text for each doc_id and one row for each text. The curve's constant
is set right for the classes' real odds.

Defined results: null and empty texts, and texts without words, have no evidence and get the curve's value
there. With no labels, or labels of one class, every score is 0. Rows that repeat are scored one by one;
labels that repeat count once, the largest first; null labels and ids don't train. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD, crc_mod, cut, give_back, logistic, map_arrow, mixed, prefix_hash, row_blocks, span_hash, text_bytes, words

MOST_LABELS, MOST_BYTES = 6_000, 100_000
#: Stands for no word before a row's first.
NONE = np.uint64(0)
#: The least and the largest discount of a count.
DISCOUNTS = (0.1, 0.95)
#: What the second pair of models takes off each count.
STRONG_DISCOUNT = 4.0
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (6, 4)
#: The most that one word can say for either class.
MOST_RATIO = 6.0
STRETCHES = (1, 4, 16)
#: Words whose own ratio reaches these values are counted.
STRONG = (1.5, 2.5)
N_EVIDENCE = 1 + len(STRETCHES) + len(STRONG)
FOLDS, HELD_OUT, CURVE_FOLD = 4, 2, 3
THRESHOLD = 0.3


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hash of each word and of its beginnings, that of the word before it (NONE: none), and where each row's
    words begin."""
    data = LOWER[data]
    starts, ends = words(data, offsets, WORD)
    prefix = prefix_hash(data)
    levels = [span_hash(prefix, starts, np.minimum(ends, starts + n)) for n in (1 << 40, *BEGINNINGS)]
    first = np.searchsorted(starts, offsets)
    before = np.concatenate([[NONE], levels[0][:-1]]) if len(starts) else levels[0]
    before[first[:-1][np.diff(first) > 0]] = NONE
    return levels, before, first


def pair_name(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of x stands in sorted keys; len(keys) if it doesn't."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.view(np.int64)) for x in columns]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for a, b in row_blocks(offsets):
            levels, before, first = _names(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            toxic = np.repeat(label[a:b], np.diff(first)) > 0
            _, at, back = np.unique(pair_name(before, levels[0]), return_index=True, return_inverse=True)
            n = [np.bincount(back[x], minlength=len(at)).astype(np.int64) for x in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays(_longs(before[at], levels[0][at], *n), ["v", "w", "toxic", "ordinary"])


def _count_words(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(w, w1, w2, n): words with their beginnings, as often as they occur; up to `most` at once."""

    def emit(parts: list) -> Iterator[pa.RecordBatch]:
        levels = [np.concatenate(x) for x in zip(*parts)]
        _, at, n = np.unique(levels[0], return_index=True, return_counts=True)
        for k in range(0, len(at), 65536):
            some = at[k : k + 65536]
            yield pa.RecordBatch.from_arrays(_longs(*(x[some] for x in levels), n[k : k + 65536].astype(np.int64)), ["w", "w1", "w2", "n"])

    parts, held = [], 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in row_blocks(offsets):
            levels, _, _ = _names(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(levels)
            held += len(levels[0])
            if held >= most:
                yield from emit(parts)
                parts, held = [], 0
    if held:
        yield from emit(parts)


WORDS = "w long, w1 long, w2 long, n long"


def word_counts(docs: DataFrame) -> DataFrame:
    """One row for each distinct word: its hash, those of its beginnings, and how often it occurs."""
    rows = map_arrow(docs.select("text"), _count_words, WORDS)
    return rows.groupBy("w").agg(F.first("w1").alias("w1"), F.first("w2").alias("w2"), F.sum("n").alias("n"))


def _shared(counts: DataFrame, keys: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """How often the corpus has each of some words and beginnings, and how many words it has in all."""
    sent = counts.sparkSession.sparkContext.broadcast(pickle.dumps(keys))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), *_longs(np.zeros(1, np.int64), n.sum(keepdims=True))], ["level", "at", "n"])
            for k, (mine, name) in enumerate(zip(held, ("w", "w1", "w2"))):
                at = place(mine, batch.column(name).to_numpy().view(np.uint64))
                some, back = np.unique(at, return_inverse=True)
                sums = np.zeros(len(some), np.int64)
                np.add.at(sums, back, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), *_longs(some, sums)], ["level", "at", "n"])

    found = map_arrow(counts, look, "level int, at long, n long").groupBy("level", "at").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    level, at, n = (found[c].to_numpy() for c in ("level", "at", "n"))
    out = []
    for k, mine in enumerate(keys):
        sums = np.zeros(len(mine) + 1, np.int64)
        sums[at[level == k]] = n[level == k]
        out.append(sums)
    return [x[:-1] for x in out], int(n[level == len(keys)].sum())


def discount(counts: np.ndarray) -> float:
    """Kneser and Ney's discount: n1 / (n1 + 2 n2), where n1 counts occur once and n2 twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(once / max(1, once + 2 * twice), *DISCOUNTS))


def usual(counts: np.ndarray) -> np.ndarray:
    return np.maximum(counts - discount(counts), 0)


def strong(counts: np.ndarray) -> np.ndarray:
    return np.maximum(counts - STRONG_DISCOUNT, 0)


#: A class is modelled once with each.
DISCOUNTED = (usual, strong)


class Vocabulary:
    """The words, beginnings, contexts and pairs of the labelled rows, as sorted names, with the corpus's counts."""

    def __init__(self, v: np.ndarray, w: np.ndarray, spelt: list[np.ndarray]):
        """v, w: the distinct pairs; spelt: the distinct words with their beginnings."""
        order = np.argsort(pair_name(v, w))
        self.pairs = pair_name(v, w)[order]
        self.contexts, self.v = np.unique(v[order], return_inverse=True)
        self.order, words_at = order, np.argsort(spelt[0])
        self.levels = [spelt[0][words_at]]
        self.w = place(self.levels[0], w[order])
        #: Of each word (beginning), its next shorter beginning.
        self.up: list[np.ndarray] = []
        longer, rest = np.arange(len(words_at)), [x[words_at] for x in spelt[1:]]
        for k, x in enumerate(rest):
            keys, at, back = np.unique(x[longer], return_index=True, return_inverse=True)
            self.levels.append(keys)
            self.up.append(back)
            longer = longer[at]


class KneserNey:
    """One class: P(w | v) = kept(v w) / c(v) + (1 - kept(v .) / c(v)) * P(w), where kept is what the discount leaves
    of a count. P(w) does the same with the class's continuation counts N1+(. w), and hands the rest to
    P(b) * shared(w) / shared(b) for the beginning b of w, and so on down to the shared counts. What the vocabulary
    doesn't have gets the last number of each array."""

    def __init__(self, known: Vocabulary, n: np.ndarray, shared: list[np.ndarray], total: int, discounted: Callable[[np.ndarray], np.ndarray]):
        once, at = np.unique(n, return_index=True)
        #: What the discount leaves of each count.
        self.kept = np.zeros(int(n.max(initial=0)) + 1, np.float32)
        self.kept[once] = discounted(n.astype(np.float64))[at]
        kept = self.kept[n]
        size = len(known.contexts)
        seen, left = np.bincount(known.v, n, size), np.bincount(known.v, kept, size)
        per = np.divide(1, seen, out=np.zeros(size), where=seen > 0)
        self.per = np.append(per, 0).astype(np.float32)
        self.rest = np.append(1 - left * per, 1).astype(np.float32)
        counts = [np.bincount(known.w[n > 0], minlength=len(known.levels[0]))]
        for up, keys in zip(known.up, known.levels[1:]):
            counts.append(np.bincount(up[counts[-1] > 0], minlength=len(keys)))
        shared = [np.maximum(x, 1).astype(np.float64) for x in shared]
        p: list[np.ndarray] = []
        for k in range(len(counts) - 1, -1, -1):
            own, all_ = discounted(counts[k].astype(np.float64)), max(1.0, float(counts[k].sum()))
            below = p[0][known.up[k]] * shared[k] / shared[k + 1][known.up[k]] if p else shared[k] / max(1, total)
            p.insert(0, own / all_ + (1 - own.sum() / all_) * below)
        self.p = [np.append(x, 0).astype(np.float64) for x in p]

    def log(self, n: np.ndarray, before: np.ndarray, p: np.ndarray) -> np.ndarray:
        """n: how often the class has each word after the word before it."""
        return np.log(self.kept[n] * self.per[before] + self.rest[before] * p)


class Model:
    def __init__(self, known: Vocabulary, counts: list[np.ndarray], sides: list[tuple[KneserNey, KneserNey]]):
        #: How often the toxic and the ordinary rows have each pair; the last is that of no pair.
        self.counts = [np.append(n, 0).astype(np.min_scalar_type(int(n.max(initial=0)))) for n in counts]
        self.pairs, self.contexts, self.levels = known.pairs, known.contexts, known.levels
        #: Toxic and ordinary, with each discount.
        self.sides, self.curve = sides, np.zeros(len(sides) * N_EVIDENCE + 1)

    def ratios(self, levels: list[np.ndarray], before: np.ndarray) -> list[np.ndarray]:
        """What each word says for the toxic class, with each discount."""
        names, at, back = np.unique(levels[0], return_index=True, return_inverse=True)
        p = np.ones((len(self.sides), 2, len(names)))
        open_ = np.arange(len(names))
        # The longest beginning that a class has decides; what both multiply it by beyond that is the same.
        for k, keys in enumerate(self.levels):
            found = place(keys, levels[k][at[open_]])
            here = found < len(keys)
            for own, models in zip(p, self.sides):
                for x, model in zip(own, models):
                    x[open_[here]] = model.p[k][found[here]]
            open_ = open_[~here]
        pair = np.full(len(back), len(self.pairs))
        ask = np.flatnonzero(place(self.levels[0], names)[back] < len(self.levels[0]))
        pair[ask] = place(self.pairs, pair_name(before[ask], levels[0][ask]))
        context, where = np.unique(before, return_inverse=True)
        context = place(self.contexts, context)[where]
        n, m = (x[pair] for x in self.counts)
        return [toxic.log(n, context, x[back]) - ordinary.log(m, context, y[back]) for (toxic, ordinary), (x, y) in zip(self.sides, p)]

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        levels, before, first = _names(data, offsets)
        if not len(before):
            return np.zeros((rows, len(self.sides) * N_EVIDENCE))
        return np.hstack([self.weigh(np.clip(x, -MOST_RATIO, MOST_RATIO), first) for x in self.ratios(levels, before)])

    @staticmethod
    def weigh(ratio: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, N_EVIDENCE))
        running = np.concatenate([[0], np.cumsum(ratio)])
        n = np.diff(first)
        some = np.flatnonzero(n)
        out[some, 0] = (running[first[1:]] - running[first[:-1]])[some] / n[some]
        begins = np.repeat(first[:-1], n)
        at = np.arange(len(ratio))
        for k, width in enumerate(STRETCHES, 1):
            mean = (running[1:] - running[np.maximum(begins, at - width + 1)]) / width
            out[some, k] = np.maximum.reduceat(mean, first[:-1][some])
        for k, least in enumerate(STRONG, 1 + len(STRETCHES)):
            out[some, k] = np.log1p(np.add.reduceat((ratio >= least).astype(np.int64), first[:-1][some]))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _packed(model: Model | None) -> bytes:
    return zlib.compress(pickle.dumps(model), 1)


def _unpacked(data: bytes) -> Model | None:
    return pickle.loads(zlib.decompress(data))


def training_rows(docs: DataFrame, labels: DataFrame, most_labels: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, fold) of the sample, and how many labelled rows of each class there are to learn from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    odds = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    sides = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels // 2) for c in (0, 1)]
    sample = sides[0].unionByName(sides[1]).withColumn("fold", crc_mod("doc_id", FOLDS).cast("int"))
    known = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(sample), "doc_id")
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"), F.min("fold").alias("fold"))
    # Exact copies are learnt from once.
    once = known.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("text", "label", "fold"), "doc_id").alias("r"))
    return once.select("r.text", "r.label", "r.fold"), odds


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model | None:
    spark = docs.sparkSession
    known, odds = training_rows(docs, labels, most_labels)
    known = cut(known)
    counting = known.where(F.col("fold") != CURVE_FOLD).select("text", "label")
    pairs = map_arrow(counting, _count_pairs, "v long, w long, toxic long, ordinary long").groupBy("v", "w").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("ordinary").cast("int").alias("ordinary")).toArrow()
    spelt = word_counts(counting).select("w", "w1", "w2").toArrow()
    names = lambda rows, *of: [rows[c].to_numpy().view(np.uint64) for c in of]
    known_words = Vocabulary(*names(pairs, "v", "w"), names(spelt, "w", "w1", "w2"))
    shared, total = _shared(word_counts(docs), known_words.levels)
    counts = [pairs[c].to_numpy()[known_words.order] for c in ("toxic", "ordinary")]
    del pairs, spelt
    model = Model(known_words, counts, [tuple(KneserNey(known_words, n, shared, total, f) for n in counts) for f in DISCOUNTED])
    sent = spark.sparkContext.broadcast(_packed(model))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets):
                found = held.evidence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(list(found), pa.list_(pa.float64()))], ["label", "x"])

    left = map_arrow(known.where(F.col("fold") == CURVE_FOLD).select("text", "label"), weigh, "label int, x array<double>").toArrow()
    sent.destroy()
    y = left["label"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    x = np.stack(left["x"].to_numpy())
    middle, spread = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - middle) / spread, y, 3 / len(y))
    # The sample has more toxic rows than there are; the real odds belong in the constant.
    shift = np.log(odds[1] / odds[0]) - np.log(y.sum() / (1 - y).sum())
    model.curve = np.concatenate([w[:-1] / spread, [w[-1] - (w[:-1] * middle / spread).sum() + shift]])
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(_packed(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(sent.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets):
                part = batch.slice(a, b - a)
                p = held.score(held.evidence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) if held else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, judge, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    return score(docs, fit(docs, labels, most_labels))
