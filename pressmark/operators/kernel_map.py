"""RBF kernel features of measured error: landmark rows and whitening (Nyström).

The kernel between two rows is approximated by the inner product of their features.  Landmarks are
added until the error on rows that are no landmarks is at most the wanted one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..plans.ranks import hash_key

#: Rows looked at to place landmarks: these many candidates, and as many others to measure the error.
SAMPLE = 1024
FIRST = 32
TARGET = 0.05
#: Directions of the landmark kernel below this share of the greatest one carry only rounding.
RANK_TOLERANCE = 1e-10

#: Rows of one product.
TILE = 240


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0.0))


@dataclass
class KernelMap:
    landmarks: np.ndarray   # at most SAMPLE rows
    whitening: np.ndarray   # landmarks x directions
    gamma: float
    error: float            # share of the kernel's size, on sampled rows that are no landmarks

    def of(self, values: np.ndarray) -> np.ndarray:
        return rbf(values, self.landmarks, self.gamma) @ self.whitening

    def transform(self, rows: DataFrame, values: str = "features_array", column: str = "features") -> DataFrame:
        """Add the kernel features of the array column ``values`` as vectors; a null array stays null."""
        of = self.of

        @F.pandas_udf("array<double>")
        def mapped(arrays: pd.Series) -> pd.Series:
            known = arrays.notna().to_numpy()
            x = np.stack(arrays[known].to_numpy()) if known.any() else np.zeros((0, 1))
            # products of one shape: a row's last bits depend less on the rows that come with it
            padded = np.concatenate([x, np.zeros((-len(x) % TILE, x.shape[1]))])
            found = iter([row for at in range(0, len(x), TILE) for row in of(padded[at:at + TILE])][:len(x)])
            return pd.Series([next(found) if k else None for k in known], dtype=object)

        return rows.withColumn(column, F.when(F.col(values).isNotNull(), array_to_vector(mapped(values))))

    def error_over(self, rows: DataFrame, probes: np.ndarray, values: str = "features_array") -> DataFrame:
        """One row (n, error): the relative error between every row and the ``probes`` (a bounded number of rows)."""
        of, gamma, theirs = self.of, self.gamma, self.of(probes)

        def measure(frames):
            for frame in frames:
                x = np.stack(frame[values].to_numpy())
                exact = rbf(x, probes, gamma)
                yield pd.DataFrame({
                    "off": ((of(x) @ theirs.T - exact) ** 2).sum(axis=1), "whole": (exact**2).sum(axis=1)})

        sums = rows.select(values).where(F.col(values).isNotNull()).mapInPandas(measure, "off double, whole double")
        return sums.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum("off") / F.sum("whole")).alias("error"))


def sampled(rows: DataFrame, n: int, salt: str, values: str = "features_array") -> np.ndarray:
    """At most ``n`` rows, those whose salted id has the smallest hash."""
    found = rows.where(F.col(values).isNotNull()).orderBy(hash_key(F.col("doc_id"), salt), "doc_id").limit(n)
    return np.array([r[0] for r in found.select(values).collect()], dtype=float)


def _whitening(kernel: np.ndarray) -> np.ndarray:
    sizes, directions = np.linalg.eigh(kernel)
    kept = sizes > RANK_TOLERANCE * sizes[-1]
    return directions[:, kept] / np.sqrt(sizes[kept])


def fit_kernel_map(
    rows: DataFrame, gamma: float = 1.0, target: float = TARGET, sample: int = SAMPLE, values: str = "features_array"
) -> KernelMap:
    """``rows`` (doc_id, array ``values``).  Landmarks double until the error is at most ``target``.

    If all ``sample`` candidates do not reach it they are all taken, and ``error`` says what is left.  With too
    few rows to hold some back the error is measured on the candidates themselves.
    """
    drawn = sampled(rows, 2 * sample, "|landmarks", values)
    if not len(drawn):
        raise ValueError("no row to place landmarks on")
    half = max(1, min(sample, len(drawn) // 2))
    candidates, others = drawn[:half], drawn[half:] if len(drawn) > half else drawn
    exact = rbf(others, others, gamma)
    size = min(FIRST, half)
    while True:
        landmarks = candidates[:size]
        model = KernelMap(landmarks, _whitening(rbf(landmarks, landmarks, gamma)), gamma, 0.0)
        mapped = model.of(others)
        model.error = float(np.linalg.norm(mapped @ mapped.T - exact) / np.linalg.norm(exact))
        if model.error <= target or size == half:
            return model
        size = min(2 * size, half)
