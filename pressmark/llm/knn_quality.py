"""Quality scores by nearest-neighbour voting among labelled documents.

A text becomes a latent-semantic vector: hashed words, word shapes and measures of the whole text,
weighted by inverse document frequency over all documents, projected on the leading singular vectors
of a labelled sample.  The labelled vectors (a bounded number) go to every task; cosines against all
of them are computed block by block, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, slices
from .wordtable import LETTERS, NOT_SPACE, gram_hashes, mix, words_of

WORDS, SHAPES, STEPS = 3072, 512, 24
#: Measures of the whole text, each as one of STEPS buckets.
MEASURES = 8
SIZE = WORDS + SHAPES + MEASURES * STEPS
DIMENSIONS = 48
#: Labelled rows fitted and kept as neighbours, at most: those with the smallest hash of their doc_id.
LABELLED = 6_000
NEIGHBOURS = 15
SHARPNESS = 6.0
FOLDS = 5
THRESHOLD = 0.3
BLOCK = 256


def features(texts: pa.Array) -> np.ndarray:
    """Counts (log scale) of every text's features; null texts count as empty."""
    n = len(texts)
    raw = words_of(texts, NOT_SPACE, lower=False)
    low = words_of(texts, LETTERS)
    hashes, owner = low.hashes(), low.owner()
    out = np.zeros((n, SIZE))
    out[:, :WORDS] = np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    data, edges = raw.bytes, raw.edges
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    sign = np.concatenate([[0], np.cumsum(NOT_SPACE[data] & ~LETTERS[data])])
    inside = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    counts = raw.counts()
    if len(raw.starts):
        s, e = raw.starts, raw.ends
        length = e - s
        shape = np.minimum(length, 15).astype(np.uint64)
        for total in (upper, digit, sign):
            part = total[e] - total[s]
            shape = shape * np.uint64(4) + np.where(part == 0, 0, np.where(part == length, 3, np.where(part == 1, 1, 2))).astype(np.uint64)
        shape = shape * np.uint64(256) + np.where(LETTERS[data[e - 1]], 0, data[e - 1]).astype(np.uint64)
        out[:, WORDS:WORDS + SHAPES] = np.bincount(
            raw.owner() * SHAPES + (mix(shape) % np.uint64(SHAPES)).astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    np.log1p(out, out=out)

    def distinct(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        own = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((values, own))
        v, o = values[order], own[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n)

    grams, gram_bounds = gram_hashes(hashes, low.bounds, 3)
    chars = np.maximum(inside[edges[1:]] - inside[edges[:-1]], 1)
    share = lambda total: (total[edges[1:]] - total[edges[:-1]]) / chars
    measures = [
        np.log2(counts + 1) / 16, share(upper) ** 0.5, share(sign) ** 0.5, share(digit) ** 0.5,
        distinct(hashes, low.bounds) / np.maximum(low.counts(), 1),
        distinct(grams, gram_bounds) / np.maximum(np.diff(gram_bounds), 1),
        chars / np.maximum(counts, 1) / 16, low.counts() / np.maximum(counts, 1) / 2,
    ]
    at = WORDS + SHAPES
    for k, value in enumerate(measures):
        # soft buckets: neighbouring values share weight
        place = np.clip(value, 0, 1) * (STEPS - 1)
        lowest = np.minimum(place.astype(np.int64), STEPS - 2)
        part = place - lowest
        rows = np.arange(n)
        out[rows, at + k * STEPS + lowest] = 1 - part
        out[rows, at + k * STEPS + lowest + 1] = part
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words, shapes and measures, each of unit length."""
    x = counts * idf
    for low, high in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, SIZE)):
        part = x[:, low:high]
        part /= np.maximum(np.sqrt((part * part).sum(axis=1, keepdims=True)), 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    """Everything a task needs: at most LABELLED vectors of DIMENSIONS numbers and one projection."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        x = unit(weighted(counts, self.idf) @ self.axes).astype(np.float32)
        cosine = x @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(float), 1e-3) ** SHARPNESS
        return (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)


def held_out(doc_id=None):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(SIZE)
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                for i in range(0, part.num_rows, BLOCK):
                    found = features(column(part.slice(i, BLOCK), "text"))
                    held += (found > 0).sum(axis=0)
                    n += len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(SIZE)], pa.int32()), pa.array([n, *held.astype(np.int64).tolist()], pa.int64())],
            names=["feature", "n"])

    counts = docs.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = {r["feature"]: r["n"] for r in counts.collect()}
    return rows.get(-1, 0), np.array([rows.get(i, 0) for i in range(SIZE)], float)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, dimensions: int = DIMENSIONS) -> Model:
    """The model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text).

    Held-out rows, null ids and null labels are never learned from; of several labels of a document the
    smallest counts, of several texts every one.
    """
    n, held = document_frequency(docs)
    idf = np.log((n + 1) / (held + 1)) + 0.1
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                for i in range(0, part.num_rows, BLOCK):
                    batch = part.slice(i, BLOCK)
                    found = features(column(batch, "text"))
                    held_ = [np.flatnonzero(row) for row in found]
                    yield pa.RecordBatch.from_arrays([
                        column(batch, "quality"), column(batch, "doc_id"),
                        pa.array([h.astype("<u2").tobytes() for h in held_], pa.binary()),
                        pa.array([row[h].astype("<f4").tobytes() for row, h in zip(found, held_, strict=True)], pa.binary()),
                    ], names=["quality", "doc_id", "places", "values"])

    # the chosen rows are at most ``limit`` pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), "text")
    rows = rows.mapInArrow(run, "quality double, doc_id bigint, places binary, values binary").orderBy("doc_id").limit(limit).collect()
    if not rows:
        return Model(idf, np.zeros((SIZE, dimensions)), np.zeros((0, dimensions), np.float32), np.zeros(0))
    counts = np.zeros((len(rows), SIZE), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["values"], "<f4")
    x = weighted(counts, idf.astype(np.float32))
    # randomised range finder with two power steps
    rng = np.random.default_rng(7)
    width = min(dimensions + 8, *x.shape)
    basis = np.linalg.qr(x.T @ rng.standard_normal((x.shape[0], width)).astype(np.float32))[0]
    for _ in range(2):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, inner = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ inner.T)[:, :dimensions].astype(np.float64)
    vectors = unit(x @ axes).astype(np.float32)
    return Model(idf, axes, vectors, np.array([float(r["quality"]) for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of an empty text.  Without labels every score is 0.5.  Rows with
    null or repeated ids are scored like any other; other columns are never read.
    """
    model = fit(docs, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                for i in range(0, part.num_rows, BLOCK):
                    batch = part.slice(i, BLOCK)
                    score = model.score(features(column(batch, "text")))
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "doc_id"), column(batch, "held_out"), pa.array(np.clip(score, 0, 1))],
                        names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
