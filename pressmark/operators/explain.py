"""Local explanations: perturb rows on the executors, score them with the model, fit a
weighted linear surrogate per row.

Samples are made again from a hash wherever they are needed; no sample text is stored.  A surrogate is
solved from weighted sums, the square of a row's own words or features, whatever the number of samples.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.lookup import broadcast_small
from ..plans.quantiles import exact_quantiles
from ..plans.staging import settle, shuffle_width

# The small solvers travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Defaults of the method.
SAMPLES = 5000
FEATURES = 10
TEXT_KERNEL = 25.0
SELECTION_RIDGE, FINAL_RIDGE = 0.01, 1.0

WORD_RUN = r"[\p{L}\p{M}\p{N}_]+"
PARTS = WORD_RUN + r"|[^\p{L}\p{M}\p{N}_]+"

ProbaFn = Callable[[DataFrame], DataFrame]
"""(doc_id, text or features, *carried) -> (doc_id, *carried, proba)."""


@dataclass(frozen=True)
class ArrayProba:
    """A model as a function of arrays, (rows x features) -> (rows x classes), that travels with the tasks.

    Samples are scored where they are drawn: only the rows themselves are shuffled, and no sample leaves its task.
    """

    score: Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class BagProba:
    """Naive Bayes over lower-cased words of two or more characters and pairs of neighbours, weighted (1 + ln tf) * idf / norm.

    ``known`` looks rows with a ``term`` up: (*rows, idf, lp) of those the model holds.  Only the terms an item's
    samples can have are looked up, once an item; samples are scored where they are drawn and none is shuffled.
    """

    known: Callable[[DataFrame], DataFrame]
    priors: list[float]
    by_rows: ProbaFn   # the same model over rows


class Sums:
    """Weighted sums of the samples of one row: all a surrogate needs, features squared in size."""

    def __init__(self, width: int, classes: int):
        self.n, self.weight, self.xx = 0, 0.0, np.zeros((width, width))
        self.x, self.y, self.yy, self.xy = np.zeros(width), np.zeros(classes), np.zeros(classes), np.zeros((width, classes))
        self.given: tuple[np.ndarray, np.ndarray] | None = None   # mask and shares of sample 0, the row itself

    def add(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, sample: np.ndarray) -> None:
        weighted = x * w[:, None]
        self.n += len(w)
        self.weight += w.sum()
        self.xx += x.T @ weighted
        self.x += weighted.sum(axis=0)
        self.xy += weighted.T @ y
        self.y += w @ y
        self.yy += w @ (y * y)
        for r in np.flatnonzero(sample == 0):
            self.given = (x[r], y[r])

    def ridge(self, label: int, alpha: float, chosen: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, float]:
        """Weighted ridge with an unpenalised intercept over the ``chosen`` features."""
        mx, my = self.x[chosen] / self.weight, self.y[label] / self.weight
        xx = self.xx[chosen][:, chosen] / self.weight - np.outer(mx, mx)
        xy = self.xy[chosen, label] / self.weight - mx * my
        coef = np.linalg.solve(xx + alpha / self.n * np.eye(len(mx)), xy)
        return coef, float(my - mx @ coef)

    def surrogate(self, top: int) -> pd.DataFrame:
        """Top features of a linear fit to the probability of the class predicted for the row itself."""
        x0, proba = self.given
        label = int(np.argmax(proba))
        # ridge strengths are meant for unnormalised sample weights
        total = self.weight / self.n
        coef, _ = self.ridge(label, SELECTION_RIDGE / total)
        chosen = np.argsort(-np.abs(coef * x0), kind="stable")[:top]
        coef, intercept = self.ridge(label, FINAL_RIDGE / total, chosen)
        order = np.argsort(-np.abs(coef), kind="stable")
        mean = self.y[label] / self.weight
        spread = self.yy[label] / self.weight - mean * mean
        # weighted mean of (y - x coef - intercept)^2 from the sums
        rest = (self.yy[label] - 2 * coef @ self.xy[chosen, label] - 2 * intercept * self.y[label]
                + coef @ self.xx[chosen][:, chosen] @ coef + 2 * intercept * coef @ self.x[chosen]) / self.weight + intercept**2
        fit = 1.0 - rest / spread if spread > 1e-15 else 0.0
        return pd.DataFrame({
            "class_idx": label, "feature_idx": chosen[order].astype(int), "weight": coef[order],
            "rank": np.arange(1, len(order) + 1), "intercept": intercept, "fit": fit,
        })


def _solved(scored: DataFrame, key: str, weigh: Callable[[np.ndarray], np.ndarray], top: int, kind: str) -> DataFrame:
    """One surrogate per ``key`` from (key, sample, mask, proba).

    The samples of a row come one after the other and leave only their sums: memory is a batch and the
    sums of one row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, None
        for frame in frames:
            if not len(frame):
                continue
            keys = frame[key].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                part = frame.iloc[low:high]
                x, y = np.stack(part["mask"].to_numpy()).astype(float), np.stack(part["proba"].to_numpy())
                if sums is None or keys[low] != now:
                    if sums is not None:
                        yield sums.surrogate(top).assign(**{key: now})
                    now, sums = keys[low], Sums(x.shape[1], y.shape[1])
                sums.add(x, y, weigh(x), part["sample"].to_numpy())
        if sums is not None:
            yield sums.surrogate(top).assign(**{key: now})

    return scored.select(key, "sample", "mask", "proba").mapInPandas(run, f"{_SURROGATE}, {key} {kind}")


_SURROGATE = "class_idx int, feature_idx int, weight double, rank int, intercept double, fit double"


def explain_text(
    docs: DataFrame, predict_proba: ProbaFn | BagProba, samples: int = SAMPLES, top: int = FEATURES, seed: int = 42
) -> DataFrame:
    """(doc_id, class_idx, feature, weight, rank, intercept, fit) for every document.

    A sample deletes all occurrences of m random words of the text, m uniform in
    1..words; sample 0 is the text itself.  A text without a word has one row of rank 0
    without feature.
    """
    parts = F.regexp_extract_all("text", F.lit(PARTS), F.lit(0))
    split = docs.select("doc_id", parts.alias("parts")).withColumn(
        "words", F.array_sort(F.array_distinct(F.filter("parts", lambda p: p.rlike(f"^{WORD_RUN}$"))))
    )
    wordless = split.where(F.coalesce(F.size("words"), F.lit(0)) == 0).select(
        "doc_id", F.lit(None).cast("int").alias("class_idx"), F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("weight"), F.lit(0).alias("rank"),
        F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("double").alias("fit"))
    split = split.where(F.size("words") > 0).select(
        "doc_id", "words",
        F.transform("parts", lambda p: F.struct(p.alias("p"), F.array_contains("words", p).alias("is_word"))).alias("parts"),
    )
    if isinstance(predict_proba, BagProba):
        # what follows a capital sigma decides about its lower case; texts of one doc_id are counted together
        alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == 1
        split = split.withColumn("plain", alone & ~F.exists("words", lambda w: F.contains(w, F.lit("\u03a3"))))
    split = settle(split)
    draw = lambda w: F.xxhash64(F.lit(seed), F.col("item"), F.col("sample"), w)

    def limited(rows: DataFrame) -> DataFrame:
        """The rank limit of (item, sample, words): a word stays if its draw lies above; nothing of it is stored."""
        removed = F.when(F.col("sample") == 0, 0).otherwise(
            F.pmod(F.xxhash64(F.lit(seed), F.lit("m"), "item", "sample"), F.size("words").cast("bigint")).cast("int") + 1
        )
        limit = F.when(F.col("m") > 0, F.element_at(F.sort_array(F.transform("words", draw)), F.greatest(F.col("m"), F.lit(1))))
        return rows.withColumn("m", removed).withColumn("limit", limit)

    kept_word = lambda w: F.col("limit").isNull() | (draw(w) > F.col("limit"))

    def weigh(x: np.ndarray) -> np.ndarray:
        cosine = np.sqrt(x.sum(axis=1) / x.shape[1])  # with the all-ones row
        return np.sqrt(np.exp(-((100 * (1 - cosine)) ** 2) / TEXT_KERNEL**2))

    def masked(rows: DataFrame) -> DataFrame:
        return limited(rows).withColumn("mask", F.transform("words", kept_word))

    def by_rows(split: DataFrame, proba: ProbaFn) -> DataFrame:
        sampled = split.select(
            F.col("doc_id").alias("item"), "words", "parts", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
        )
        # the articles are few and the samples many: spread the samples
        perturbed = limited(sampled.repartition("item", "sample")).select(
            # a key of its own for every sample: item and sample as text never overflow or collide
            F.concat_ws(":", "item", "sample").alias("doc_id"), "item", "sample",
            F.array_join(
                F.transform(F.filter("parts", lambda s: ~s["is_word"] | kept_word(s["p"])), lambda s: s["p"]), ""
            ).alias("text"),
        )
        scored = proba(perturbed).select("item", "sample", "proba")
        words = split.select(F.col("doc_id").alias("item"), "words")
        # only the shares move to the item's task; its words come once and the masks are made again there
        together = scored.join(words.hint("shuffle_hash"), "item").sortWithinPartitions("item", "sample")
        return _solved(masked(together), "item", weigh, top, "bigint")

    if isinstance(predict_proba, BagProba):
        solved = _solved_bags(split.where("plain AND doc_id IS NOT NULL"), predict_proba, masked, weigh, samples, top)
        others = split.where("NOT plain")
        if not others.isEmpty():
            solved = solved.unionByName(by_rows(others, predict_proba.by_rows))
    else:
        solved = by_rows(split, predict_proba)
    named = split.select(F.col("doc_id").alias("item"), F.posexplode("words").alias("feature_idx", "feature"))
    return solved.join(named, ["item", "feature_idx"]).select(
        F.col("item").alias("doc_id"), "class_idx", "feature", "weight", "rank", "intercept", "fit"
    ).unionByName(wordless)


class _Bag:
    """The terms of one text's samples that a model holds."""

    def __init__(self, spelt, occurs, a, b, idf, lp, priors: np.ndarray):
        tokens, number = _numbered(spelt)
        occurs = np.asarray(occurs, dtype=np.int64)
        self.words = occurs[number[occurs] >= 0]
        self.tokens, self.width, self.priors = number[self.words], len(tokens), priors
        codes = _codes(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64), self.width)
        order = np.argsort(codes)
        self.codes, self.idf = codes[order], np.asarray(idf, dtype=float)[order]
        self.lp = np.asarray(lp, dtype=float).reshape(len(codes), len(priors))[order]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Class shares of samples, one row of kept words each."""
        step = max(1, CELLS // max(1, len(self.words)))
        return np.vstack([self._shares(x[low:low + step]) for low in range(0, len(x), step)])

    def _shares(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.priors, (len(x), 1))
        if len(self.codes):
            row, place = np.nonzero(x[:, self.words])
            token = self.tokens[place]
            near = row[1:] == row[:-1]
            rows = np.concatenate([row, row[1:][near]])
            codes = np.concatenate([token, _codes(token[:-1][near], token[1:][near], self.width)])
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            held = self.codes[at] == codes
            cells, tf = np.unique(rows[held] * len(self.codes) + at[held], return_counts=True)
            row, term = np.divmod(cells, len(self.codes))
            weight = (1.0 + np.log(tf)) * self.idf[term]
            norm = np.sqrt(np.bincount(row, weight * weight, len(x)))
            for c in range(score.shape[1]):
                score[:, c] += np.divide(np.bincount(row, weight * self.lp[term, c], len(x)), norm, out=np.zeros(len(x)), where=norm > 0)
        odds = np.exp(score - score.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


#: Words of samples looked at together.
CELLS = 1_000_000


def _numbered(spelt) -> tuple[list[str], np.ndarray]:
    """The distinct tokens in order, and the token of every word, -1 where it has none."""
    tokens = sorted({t for t in spelt if t is not None})
    number = {t: i for i, t in enumerate(tokens)}
    return tokens, np.array([-1 if t is None else number[t] for t in spelt], dtype=np.int64)


def _codes(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """One number per token (b = -1) or pair of tokens."""
    return np.where(b < 0, a, (a + 1) * width + b)


def _possible_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, a, b, term): every token of a text, and every two of which one comes before the other."""
    for frame in frames:
        for item, spelt, occurs in zip(frame["item"], frame["spelt"], frame["occurs"]):
            tokens, number = _numbered(spelt)
            line = number[np.asarray(occurs, dtype=np.int64)]
            line = line[line >= 0]
            first, last = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
            last[line] = np.arange(len(line))
            first[line[::-1]] = np.arange(len(line))[::-1]
            yield pd.DataFrame({"item": item, "a": np.arange(len(tokens)), "b": -1, "term": pd.Series(tokens, dtype=object)})
            step = max(1, 100_000 // max(1, len(tokens)))
            for low in range(0, len(tokens), step):
                a, b = np.nonzero(first[low:low + step, None] < last)
                yield pd.DataFrame({"item": item, "a": a + low, "b": b, "term": pd.Series(
                    [f"{tokens[i + low]} {tokens[j]}" for i, j in zip(a, b)], dtype=object)})


def _solved_bags(split: DataFrame, model: BagProba, masked: Callable, weigh: Callable, samples: int, top: int) -> DataFrame:
    """One surrogate per text, as of ``_solved``; its samples are drawn and scored in the text's task."""
    spelling = F.transform("words", lambda w: F.when(F.length(F.lower(w)) >= 2, F.lower(w)))
    line = F.transform(F.filter("parts", lambda s: s["is_word"]), lambda s: (F.array_position(F.col("words"), s["p"]) - 1).cast("int"))
    texts = split.select(F.col("doc_id").alias("item"), "words", spelling.alias("spelt"), line.alias("occurs"))
    width = shuffle_width(split)
    possible = texts.select("item", "spelt", "occurs").repartition(width).mapInPandas(
        lambda frames: _in_lots(_possible_terms(frames)), "item bigint, a int, b int, term string")
    held = model.known(possible).groupBy("item").agg(F.collect_list(F.struct("a", "b", "idf", "lp")).alias("held"))
    of = lambda name: F.transform(F.coalesce("held", F.array().cast(held.schema["held"].dataType)), lambda t: t[name])
    own = F.struct("spelt", "occurs", of("a").alias("a"), of("b").alias("b"), of("idf").alias("idf"), F.flatten(of("lp")).alias("lp"))
    whole = texts.join(settle(held).hint("shuffle_hash"), "item", "left").repartition(width).select("item", "words", own.alias("own"))
    # one row a text up to here, dealt evenly; what belongs to the text comes with its first sample
    numbers = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.struct(s.alias("sample"), F.when(s == 0, F.col("own")).alias("own")))
    drawn = masked(whole.select("item", "words", F.inline(numbers))).select("item", "sample", "mask", "own.*")
    priors = np.array(model.priors, dtype=float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bag, sums = None, None, None
        for frame in frames:
            numbers = frame["sample"].to_numpy()
            edges = [*np.flatnonzero(numbers == 0).tolist(), len(numbers)]
            for low, high in zip([0, *edges], edges):
                if low == high:
                    continue
                part = frame.iloc[low:high]
                if numbers[low] == 0:
                    if sums is not None:
                        yield sums.surrogate(top).assign(item=now)
                    r = part.iloc[0]
                    now, bag, sums = r["item"], _Bag(r["spelt"], r["occurs"], r["a"], r["b"], r["idf"], r["lp"], priors), None
                mask = np.stack(part["mask"].to_numpy()).astype(bool)
                x, y = mask.astype(float), bag.shares(mask)
                sums = sums or Sums(x.shape[1], y.shape[1])
                sums.add(x, y, weigh(x), numbers[low:high])
        if sums is not None:
            yield sums.surrogate(top).assign(item=now)

    return drawn.mapInPandas(lambda frames: _in_lots(run(frames)), f"{_SURROGATE}, item bigint")


# --- tabular rows ---------------------------------------------------------------------


class TrainingBins:
    """Quartile bins of every feature: borders, frequencies, and a value table per bin."""

    GRID = 129

    def __init__(self, names, borders, frequency, tables):
        self.names, self.borders, self.frequency, self.tables = names, borders, frequency, tables

    @classmethod
    def fit(cls, rows: DataFrame, features: str = "features_array") -> "TrainingBins":
        """``rows`` (doc_id, array column); one row per feature and bin reaches the driver."""
        long = rows.select(F.posexplode(features).alias("key", "value")).select("key", F.col("value").cast("double").alias("value"))
        quartiles = settle(exact_quantiles(long, [0.25, 0.5, 0.75]))
        joined = long.join(broadcast_small(quartiles), "key")
        bins = (
            joined.withColumn("bin", F.size(F.filter("q", lambda b: F.col("value") > b)))
            .groupBy("key", "bin").agg(
                F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                F.min("value").alias("low"), F.max("value").alias("high"),
            ).collect()
        )
        borders = {r.key: list(r.q) for r in quartiles.collect()}
        dim = len(borders)
        frequency = np.zeros((dim, 4))
        tables = np.zeros((dim, 4, cls.GRID))
        for r in bins:
            frequency[r.key, r.bin] = r.n
            tables[r.key, r.bin] = cls._truncated_normal(r.mean, r.std, r.low, r.high)
        frequency /= frequency.sum(axis=1, keepdims=True)
        return cls(list(range(dim)), np.array([borders[i] for i in range(dim)]), frequency, tables)

    @classmethod
    def _truncated_normal(cls, mean, std, low, high) -> np.ndarray:
        """Quantiles of the normal (mean, std) cut to [low, high]."""
        if not std or low == high:
            return np.full(cls.GRID, mean)
        normal = NormalDist(mean, std)
        a, b = normal.cdf(low), normal.cdf(high)
        inner = [normal.inv_cdf(a + (b - a) * i / (cls.GRID - 1)) for i in range(1, cls.GRID - 1)]
        return np.array([low, *inner, high])


#: Samples worked on at once: their arrays stay in the processor's cache.
CHUNK = 512


def _draw_chunks(row, borders, frequency, tables, samples, rng) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, values, same-bin indicators) of some samples after the others; sample 0 is the given row."""
    dim, grid = len(row), tables.shape[2]
    own = (row[:, None] > borders).sum(axis=1)
    limits, flat, start = frequency.cumsum(axis=1).T[:3], tables.ravel(), np.arange(dim) * tables.shape[1]
    draws, places = rng.random((samples, dim)), rng.random((samples, dim))
    for low in range(0, samples, CHUNK):
        draw, position = draws[low:low + CHUNK], places[low:low + CHUNK] * (grid - 1)
        bins = (draw > limits[0]).astype(np.int64)
        bins += draw > limits[1]
        bins += draw > limits[2]
        left = position.astype(np.int64)
        cell = (start + bins) * grid
        lower = flat.take(cell + left)
        upper = flat.take(cell + np.minimum(left + 1, grid - 1))
        values = lower + (upper - lower) * (position - left)
        same = bins == own
        if low == 0:
            values[0], same[0] = row, True
        yield np.arange(low, low + len(draw)), values, same


def _draw_row(row, borders, frequency, tables, samples, rng):
    """(values, same-bin indicators); row 0 is the given row."""
    _, values, same = zip(*_draw_chunks(row, borders, frequency, tables, samples, rng))
    return np.concatenate(values), np.concatenate(same)


def _dealt(rows: DataFrame, features: str) -> DataFrame:
    """The rows by doc_id, in a fixed number of parts: a row is small and its samples are many."""
    return rows.select("doc_id", features).repartition(shuffle_width(rows), "doc_id")


def _rows_by_key(frames: Iterator[pd.DataFrame], features: str) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(doc_id, whether another doc_id came before, row) of frames sorted by doc_id."""
    before = None
    for frame in frames:
        for item, row in zip(frame["doc_id"], frame[features]):
            yield item, item != before, np.asarray(row, dtype=float)
            before = item


def _in_lots(found: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Many small frames as few larger ones."""
    lot, n = [], 0
    for frame in found:
        lot.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(lot, ignore_index=True)
            lot, n = [], 0
    if lot:
        yield pd.concat(lot, ignore_index=True)


def explain_rows(
    rows: DataFrame, bins: TrainingBins, predict_proba: ProbaFn | ArrayProba, samples: int = SAMPLES, top: int = FEATURES,
    seed: int = 42, features: str = "features_array",
) -> DataFrame:
    """(doc_id, class_idx, feature_idx, weight, rank, intercept, fit) for every row.

    Each feature is drawn from the training distribution of its quartile bins; the
    surrogate sees whether a sample fell into the row's own bin.  Rows of one doc_id share a surrogate.
    """

    borders, frequency, tables = bins.borders, bins.frequency, bins.tables

    def generator(item: int) -> np.random.Generator:
        return np.random.default_rng([seed, int(item) & 0x7FFFFFFFFFFFFFFF])

    def weigh(x: np.ndarray) -> np.ndarray:
        # sample 0 lies in all of the row's own bins
        width = np.sqrt(x.shape[1]) * 0.75
        return np.sqrt(np.exp(-((x - 1.0) ** 2).sum(axis=1) / width**2))

    columns = ["doc_id", *[c.split()[0] for c in _SURROGATE.split(", ")]]
    if isinstance(predict_proba, ArrayProba):
        score = predict_proba.score

        def explained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, sums = None, None
            for item, new, row in _rows_by_key(frames, features):
                if new:
                    if sums is not None:
                        yield sums.surrogate(top).assign(doc_id=now)
                    now, sums = item, None
                for numbers, values, same in _draw_chunks(row, borders, frequency, tables, samples, generator(item)):
                    x, y = same.astype(float), score(values)
                    sums = sums or Sums(x.shape[1], y.shape[1])
                    sums.add(x, y, weigh(x), numbers)
            if sums is not None:
                yield sums.surrogate(top).assign(doc_id=now)

        by_key = _dealt(rows, features).sortWithinPartitions("doc_id")
        return by_key.mapInPandas(lambda frames: _in_lots(explained(frames)), f"{_SURROGATE}, doc_id bigint").select(*columns)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, row in zip(frame["doc_id"], frame[features]):
                values, same = _draw_row(np.asarray(row, dtype=float), borders, frequency, tables, samples, generator(item))
                yield pd.DataFrame({
                    "doc_id": item, "sample": np.arange(samples, dtype=np.int32), "x": list(values), "mask": list(same),
                })

    drawn = _dealt(rows, features).mapInPandas(draw, "doc_id bigint, sample int, x array<double>, mask array<boolean>")
    scored = predict_proba(drawn.withColumn("features", array_to_vector("x")).drop("x"))
    together = scored.select("doc_id", "sample", "mask", "proba").repartition("doc_id").sortWithinPartitions("doc_id", "sample")
    return _solved(together, "doc_id", weigh, top, "bigint").select(*columns)


def tabular_samples(n_features: int) -> int:
    """Default sample count: more for wide rows."""
    return SAMPLES if n_features <= 1000 else 5 * n_features


def kernel_shap(
    rows: DataFrame, background: np.ndarray, shares: np.ndarray, predict_proba: ProbaFn | ArrayProba, samples: int,
    seed: int = 42, features: str = "features_array",
) -> DataFrame:
    """(doc_id, class_idx, feature_idx, value, base): Shapley values of the class probabilities.

    A coalition keeps some features of the row and takes the others from the
    background rows (weighted by ``shares``).  Sizes are drawn from the Shapley
    kernel, each coalition together with its complement; the weighted fit keeps the
    sum of the values equal to f(row) - f(background).  Shares of rows of one doc_id add up.
    """
    dim = background.shape[1]
    schema = "doc_id bigint, class_idx int, feature_idx int, value double, base double"

    def coalitions(item: int) -> np.ndarray:
        rng = np.random.default_rng([seed, int(item) & 0x7FFFFFFFFFFFFFFF])
        sizes = np.arange(1, dim)
        chance = 1.0 / (sizes * (dim - sizes))
        half = max(1, samples // 2)
        count = rng.choice(sizes, size=half, p=chance / chance.sum())
        order = rng.random((half, dim)).argsort(axis=1).argsort(axis=1)
        mask = order < count[:, None]
        return np.vstack([np.zeros(dim, bool), np.ones(dim, bool), mask, ~mask])

    def solve(item: int, mask: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        base, gain = f[0], f[1] - f[0]
        z, y = mask[2:].astype(float), f[2:] - base
        # the last feature takes up the constraint sum(phi) = gain
        reduced = z[:, :-1] - z[:, -1:]
        target = y - z[:, -1:] * gain
        gram = reduced.T @ reduced + 1e-9 * np.eye(reduced.shape[1])
        phi = np.linalg.solve(gram, reduced.T @ target)
        phi = np.vstack([phi, gain - phi.sum(axis=0)])
        k = phi.shape[1]
        return pd.DataFrame({
            "doc_id": item, "class_idx": np.tile(np.arange(k), dim), "feature_idx": np.repeat(np.arange(dim), k),
            "value": phi.ravel(), "base": np.tile(base, dim),
        })

    if isinstance(predict_proba, ArrayProba):
        score = predict_proba.score

        def explained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, mask, f = None, None, None
            for item, new, row in _rows_by_key(frames, features):
                if new:
                    if f is not None:
                        yield solve(now, mask, f)
                    now, mask, f = item, coalitions(item), 0.0
                for other, share in zip(background, shares):
                    f = f + score(np.where(mask, row, other)) * share
            if f is not None:
                yield solve(now, mask, f)

        by_key = _dealt(rows, features).sortWithinPartitions("doc_id")
        return by_key.mapInPandas(lambda frames: _in_lots(explained(frames)), schema)

    def draw(frames):
        for frame in frames:
            for item, row in zip(frame["doc_id"], frame[features]):
                row, mask = np.asarray(row, dtype=float), coalitions(item)
                for other, share in zip(background, shares):
                    yield pd.DataFrame({
                        "doc_id": item, "sample": np.arange(len(mask), dtype=np.int32), "share": float(share),
                        "x": list(np.where(mask, row, other)),
                    })

    drawn = _dealt(rows, features).mapInPandas(
        draw, "doc_id bigint, sample int, share double, x array<double>"
    )
    scored = predict_proba(drawn.withColumn("features", array_to_vector("x")).drop("x"))

    def gathered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the coalitions are drawn again: only shares are shuffled
        mask = coalitions(key[0])
        p = np.stack(group["proba"].to_numpy()) * group["share"].to_numpy()[:, None]
        f = np.zeros((len(mask), p.shape[1]))
        np.add.at(f, group["sample"].to_numpy(), p)
        return solve(key[0], mask, f)

    return scored.select("doc_id", "sample", "share", "proba").groupBy("doc_id").applyInPandas(gathered, schema)
