"""Encoders as files that workers open once: a linear head (affine map and L2 norm) on pooled pixels or on vectors.

A model is written to one .npz file and shipped with SparkContext.addFile, so a plan carries its name and not its
weights. A worker process opens it when it first needs it and keeps it for all batches and plans that follow.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import EPS

#: Of this process: models that are open, by file name, and how often each was opened.
_OPEN: dict[str, dict[str, np.ndarray]] = {}
opened: dict[str, int] = {}


def write_head(path: str, weights: np.ndarray, bias: np.ndarray | None = None, grid: int = 1) -> None:
    """A head of shape (d, n) on n inputs; grid: the picture is pooled to so many rows and columns of means."""
    weights = np.asarray(weights, np.float64)
    bias = np.zeros(len(weights)) if bias is None else np.asarray(bias, np.float64)
    if weights.ndim != 2 or bias.shape != (len(weights),) or grid < 1 or not (np.isfinite(weights).all() and np.isfinite(bias).all()):
        raise ValueError("a head has finite weights (d, n), a bias (d) and a grid above 0")
    with open(path, "wb") as file:
        np.savez(file, weights=weights, bias=bias, grid=grid)


def projected(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows of x through the affine map, each divided by its length; a row of zeros stays."""
    y = x @ weights.T + bias
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), EPS)


def pooled(x: np.ndarray, grid: int) -> np.ndarray:
    """(n, channels, size, size) as means of grid x grid cells, (n, channels * grid * grid)."""
    n, c, h, w = x.shape
    rows, columns = (np.linspace(0, m, grid + 1).astype(int)[:-1] for m in (h, w))
    sums = np.add.reduceat(np.add.reduceat(x.astype(np.float64), rows, axis=2), columns, axis=3)
    area = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(columns, w))[None]
    return (sums / area).reshape(n, c * grid * grid)


class ShippedHead:
    """A head in a file that every worker has; callable on pictures (n, channels, size, size) as an encoder."""

    def __init__(self, spark: SparkSession, weights: np.ndarray, bias: np.ndarray | None = None, grid: int = 1):
        # A name of its own: a file that was sent can't be replaced. The driver's folder of such files holds it.
        self.name = f"head-{uuid.uuid4().hex}.npz"
        path = os.path.join(SparkFiles.getRootDirectory(), self.name)
        write_head(path, weights, bias, grid)
        spark.sparkContext.addFile(path)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> ShippedHead:
        with np.load(path) as file:
            return cls(spark, file["weights"], file["bias"], int(file["grid"]))

    def model(self) -> dict[str, np.ndarray]:
        if self.name not in _OPEN:
            with np.load(SparkFiles.get(self.name)) as file:
                _OPEN[self.name] = {k: file[k] for k in file.files}
            opened[self.name] = opened.get(self.name, 0) + 1
        return _OPEN[self.name]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = self.model()
        return projected(pooled(x, int(m["grid"])), m["weights"], m["bias"])

    def vectors(self, rows: DataFrame, key: str, value: str = "embedding") -> DataFrame:
        """key and embedding: the head on vectors instead of pictures. Null vectors, and those of another length, are errors."""
        kind = rows.schema[key].dataType.simpleString()

        def run(batches):
            for batch in batches:
                m = self.model()
                column, n = batch.column(value), m["weights"].shape[1]
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if column.null_count or (np.diff(column.offsets.to_numpy()) != n).any():
                    raise ValueError(f"the head takes vectors of {n} numbers")
                out = projected(flat.reshape(-1, n), m["weights"], m["bias"])
                ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], [key, "embedding"])

        return rows.select(key, value).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")
