"""Quality scores (operator 2): random Fourier features of document statistics, ridge regression from partition-summed
normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import steps, utf8

#: Random features, their seed, the kernel's width in standard deviations of a statistic, and the ridge penalty.
FEATURES, SEED, WIDTH, PENALTY = 128, 20240229, 3.0, 0.3
#: Bins of the raw score in which labels are counted for calibration, over the range RANGE.
BINS, RANGE = 2048, (-0.5, 1.5)
#: Tasks that sum normal equations; the sums shuffled are this many matrices at most.
TASKS = 32

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "distinct_words", "log_lines", "repeated_lines", "line_bytes", "upper", "digit", "blank",
    "stop", "symbol", "wide", "entropy", "top_symbol", "short_words",
]


def statistics(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text, from byte counts and from its words and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    share = lambda codes: counts[:, codes].sum(1) / some
    stops = [ord(c) for c in ".,;:?\n '\"()-"]
    symbols = [c for c in range(33, 127) if not chr(c).isalnum() and c not in stops]
    p = counts / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    words = np.zeros((n, 3))
    for i, text in enumerate(texts):
        w = text.split()
        lines = text.split("\n")
        words[i] = len(w), len(set(w)), len(lines) - len(set(lines))
    n_words = np.maximum(words[:, 0], 1)
    n_lines = counts[:, 10] + 1
    blank = counts[:, [9, 10, 13, 32]].sum(1)
    return np.stack(
        [
            np.log1p(size), np.log1p(words[:, 0]), np.log1p((size - blank) / n_words), words[:, 1] / n_words, np.log1p(n_lines), words[:, 2] / n_lines,
            np.log1p(size / n_lines), share(list(range(65, 91))), share(list(range(48, 58))), blank / some, share([46, 44]), share(symbols),
            share(list(range(128, 256))), entropy, counts[:, symbols].max(1) / some, words[:, 1] / np.sqrt(n_words),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame, id_cols: list[str]) -> DataFrame:
    """The id columns and `stats`, an array of STATISTICS over the whole text (null: empty); one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            data, offsets = utf8(batch.column("__text"))
            found = statistics(data, offsets, [t or "" for t in batch.column("__text").to_pylist()])
            flat = pa.array(found.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), lists], names=[*id_cols, "stats"])

    own = docs.select(*id_cols, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*id_cols, F.expr("cast(null as array<double>) as stats")).schema
    return own.mapInArrow(run, schema)


class Model:
    """Means and deviations of the statistics, ridge weights, and the calibrated levels. `rows` labels taught it."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray, knots: np.ndarray, levels: np.ndarray, rows: int):
        self.mean, self.deviation, self.weights, self.knots, self.levels, self.rows = mean, deviation, weights, knots, levels, rows

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if not self.rows:
            return np.full(len(stats), 0.5)
        return np.interp(features(stats, self.mean, self.deviation) @ self.weights, self.knots, self.levels)


def features(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """A constant and cosines of random projections: their products approximate a Gaussian kernel."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / deviation, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)], axis=1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centre and level of each pool of ascending x."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame, folds: int = 4) -> Model:
    """Fits on (stats, label 0/1, fold 0..folds-1). Labels other than 0 and 1 are left out; no label gives a model that
    says 0.5. Each fold's normal equations are summed by Spark over all rows; leaving a fold out of the sum gives the
    scores on which it is calibrated, so calibration never sees a score learned from its own label. The driver gets
    (FEATURES + 2)^2 sums a fold and BINS counts, whatever the number of rows."""
    rows = labelled.where("label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"), "fold")
    each = [F.struct(F.sum(F.col("stats")[i]), F.sum(F.col("stats")[i] * F.col("stats")[i])) for i in range(len(STATISTICS))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(e.alias(f"s{i}") for i, e in enumerate(each))).first()
    n = sums["n"]
    if not n:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 0)
    first, second = np.array([list(s) for s in sums[1:]]).T
    mean = first / n
    deviation = np.sqrt(np.maximum(second / n - mean**2, 0))
    deviation[deviation < 1e-9] = 1.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, label = batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            phi = np.concatenate([features(_rows(batch), mean, deviation), label[:, None]], axis=1)
            for k in np.unique(fold):
                grams[int(k)] = grams.get(int(k), 0) + phi[fold == k].T @ phi[fold == k]
        i, j = np.triu_indices(FEATURES + 2)
        for k, g in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i * (FEATURES + 2) + j, pa.int32()), pa.array(g[i, j])], names=["fold", "cell", "v"])

    cells = rows.repartition(TASKS).mapInArrow(partial, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect()
    grams = np.zeros((folds, (FEATURES + 2) ** 2))
    for fold, cell, v in cells:
        grams[fold, cell] = v
    grams = grams.reshape(folds, FEATURES + 2, FEATURES + 2)
    grams = grams + np.triu(grams, 1).transpose(0, 2, 1)

    def solve(g: np.ndarray) -> np.ndarray:
        a = g[:-1, :-1] + PENALTY * np.diag([0.0] + [1.0] * FEATURES) + 1e-9 * np.eye(FEATURES + 1)
        return np.linalg.solve(a, g[:-1, -1])

    total = grams.sum(0)
    without = [solve(total - grams[k]) if (total - grams[k])[0, 0] > 0 else solve(total) for k in range(folds)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = features(_rows(batch), mean, deviation)
            raw = np.einsum("ij,ij->i", phi, np.stack(without)[batch.column("fold").to_numpy()])
            bins = np.clip((raw - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(raw), batch.column("label")], names=["bin", "raw", "label"])

    counted = rows.mapInArrow(scored, "bin int, raw double, label double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    x, ones, weight = (np.array([float(r[c]) for r in counted]) for c in ("raw", "ones", "n"))
    knots, levels = isotonic(x, ones / weight, weight)
    return Model(mean, deviation, solve(total), knots, np.clip(levels, 0, 1), n)


def score(with_stats: DataFrame, model: Model, id_cols: list[str], threshold: float = 0.3) -> DataFrame:
    """The id columns, score (0 to 1) and predicted (1 if score >= threshold, else 0), for every row."""
    shared = with_stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.round(shared.value.probability(_rows(batch)), 9)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_cols), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*id_cols, "score", "predicted"])

    schema = with_stats.select(*id_cols, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return with_stats.mapInArrow(run, schema)
