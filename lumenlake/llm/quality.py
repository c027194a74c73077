"""Quality by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of CHUNK positions that overlap by the width of the filters less one,
so that no position of the text is left out. Learned filters run over each chunk and the largest answer of each
filter is the chunk's vector; the largest and the mean over the chunks are the document's, and a logistic layer
makes one probability of them. Filters are products of a byte embedding, so a filter's answer is a sum of one
table row for each byte, and training needs gradients at the positions of the maxima alone.

Training runs on the driver, on at most MOST_LABELS labelled rows of at most MOST_BYTES bytes each (longer rows
are left out of training, not shortened); scoring covers every byte of every text. The model is a few tens of kB.

Defined results: null and empty texts have one chunk of padding and get the network's value for it. With no
labels, or labels of one class, every score is 1 (nothing is rejected). Rows that repeat are scored one by one;
labels that repeat count once, the largest first; of a doc_id with several texts one trains. Extra columns are ignored, or kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, label_sample, map_arrow, row_blocks, text_bytes

CHUNK, WIDTH, FILTERS, EMBEDDING = 250, 6, 8, 8
MOST_LABELS, MOST_BYTES = 4_000, 12_000
STEPS, BATCH = 800, 32
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PAD = 256


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of all chunks, a row each with its overlap, and where each document's chunks begin."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-n // CHUNK))
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    start = (np.arange(first[-1]) - first[owner]) * CHUNK
    at = start[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = at < n[owner][:, None]
    at += offsets[owner][:, None]
    at[~inside] = 0
    codes = data[at].astype(np.int16) if len(data) else np.zeros(at.shape, np.int16)
    codes[~inside] = PAD
    return codes, first


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embedding": r.normal(0, 0.5, (PAD + 1, EMBEDDING)).astype(np.float32),
            "filters": r.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "last": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        t = np.stack([self.p["embedding"] @ w for w in self.p["filters"]])
        t[:, PAD] = 0
        return t

    def pair_tables(self) -> np.ndarray:
        """The rows of tables() summed for each two bytes in a row, which halves the work of scoring."""
        t = self.tables()
        return np.stack([(t[k][:, None] + t[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)])

    def answers(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(chunks, CHUNK, FILTERS): what each filter answers at each position. tables: tables() or pair_tables()."""
        width = WIDTH // len(tables)
        if width == 2:
            codes = codes[:, :-1].astype(np.int32) * (PAD + 1) + codes[:, 1:]
        total = tables[0].take(codes[:, :CHUNK], 0)
        for k in range(1, len(tables)):
            total += tables[k].take(codes[:, width * k : width * k + CHUNK], 0)
        return total

    def pooled(self, codes: np.ndarray, tables: np.ndarray, step: int = 64) -> np.ndarray:
        parts = [self.answers(codes[k : k + step], tables).max(1) for k in range(0, len(codes), step)]
        return np.maximum(np.concatenate(parts) + self.p["bias"], 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(pooled, first[:-1])
        mean = np.add.reduceat(pooled, first[:-1]) / np.diff(first)[:, None]
        return np.hstack([most, mean])

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        codes, first = chunks(data, offsets)
        vector = self.combine(self.pooled(codes, self.pair_tables() if tables is None else tables), first)
        return 1 / (1 + np.exp(-np.clip(vector @ self.p["out"] + self.p["last"], -30, 30).astype(np.float64)))

    def gradients(self, codes: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, tables = self.p, self.tables()
        answers = self.answers(codes, tables)
        where = answers.argmax(1)
        raw = np.take_along_axis(answers, where[:, None], 1)[:, 0] + p["bias"]
        pooled = np.maximum(raw, 0)
        vector = self.combine(pooled, first)
        guess = 1 / (1 + np.exp(-np.clip(vector @ p["out"] + p["last"], -30, 30)))
        error = (guess - y).astype(np.float32) / len(y)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(count)), count)
        back = error[:, None] * p["out"]
        is_most = pooled == vector[owner, :FILTERS]
        ties = np.add.reduceat(is_most.astype(np.float32), first[:-1])
        g = back[owner, :FILTERS] * is_most / ties[owner] + back[owner, FILTERS:] / count[owner][:, None]
        g = (g * (raw > 0)).astype(np.float32)
        lane = np.arange(FILTERS)
        filters, embedding = np.zeros_like(p["filters"]), np.zeros_like(p["embedding"])
        for k in range(WIDTH):
            byte = codes[np.arange(len(codes))[:, None], where + k]
            t = np.bincount((byte.astype(np.int64) * FILTERS + lane).ravel(), g.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS).astype(np.float32)
            t[PAD] = 0
            filters[k] = p["embedding"].T @ t
            embedding += t @ p["filters"][k].T
        return {"embedding": embedding, "filters": filters, "bias": g.sum(0), "out": (vector * error[:, None]).sum(0) + 1e-4 * p["out"], "last": error.sum(keepdims=True)}

    def train(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> None:
        """Adam; each batch has as many rows of either class as the other, and the constant is set right afterwards."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        sides = [np.flatnonzero(y == c) for c in (0, 1)]
        for step in range(1, steps + 1):
            rows = np.concatenate([r.choice(s, batch // 2) for s in sides])
            part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in rows])
            codes, first = chunks(part, np.concatenate([[0], np.cumsum(np.diff(offsets)[rows])]))
            rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
            for k, g in self.gradients(codes, first, y[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        # Balanced batches make the classes look equally likely; their odds belong in the constant.
        self.p["last"] += np.float32(np.log(len(sides[1]) / len(sides[0])))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, steps: int = STEPS) -> Network | None:
    sample = label_sample(labels, "quality", most_labels, FOLDS, HELD_OUT)
    known = docs.select("doc_id", "text").where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(sample), "doc_id")
    # One text for each doc_id, so that the sample's bound is one of rows.
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = known.select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    y = rows["label"].to_numpy().astype(np.float32)
    if len(np.unique(y)) < 2:
        return None
    data, offsets = text_bytes(rows["text"].combine_chunks())
    network = Network()
    network.train(data, offsets, y, steps)
    give_back()
    return network


def _judge(sent, keep: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        tables = network.pair_tables() if network else None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in row_blocks(offsets, 1 << 19):
                part = batch.slice(a, b - a)
                p = network.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tables) if network else np.ones(b - a)
                if keep:
                    good = part.filter(pa.array(p >= THRESHOLD))
                    if good.num_rows:
                        yield good
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return judge


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return map_arrow(rows, _judge(docs.sparkSession.sparkContext.broadcast(network), False), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, all their columns."""
    return map_arrow(docs, _judge(docs.sparkSession.sparkContext.broadcast(network), True), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    return score(docs, fit(docs, labels, most_labels))
