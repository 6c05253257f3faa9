"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics are standardised with the means and deviations of all documents.
cos(w x + b) with Gaussian w approximates a Gaussian kernel.  Each partition sums
its own normal equations, the sums of all partitions are added up by matrix row,
and the small system is solved once.  A hashed fifth of the labelled rows is kept
out of the fit and calibrates the scores by isotonic regression.

Nulls and odd cases: null and empty texts get the score of a text without words;
labels other than 0 and 1 and labels of unknown ids teach nothing; with no usable
labels every score is 0.5; with a single class it is that class's share; repeated
rows get equal scores; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seguelake.llm.statistics import document_counts, labelled
from seguelake.session import cut_lineage

STATISTICS = {
    "size": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "sqrt(n_symbols / greatest(word_chars, 1))",
    "capitals": "sqrt(n_upper / greatest(word_chars, 1))",
    "digits": "sqrt(n_digits / greatest(word_chars, 1))",
    "marks": "sqrt(n_marks / greatest(n_words, 1))",
    "stops": "sqrt(n_stops / greatest(n_words, 1))",
    "accents": "sqrt(n_accent / greatest(word_chars, 1))",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "echoes": "sqrt(n_echo / greatest(n_words, 1))",
    "variety": "n_distinct / greatest(n_words, 1)",
    "lines": "ln(1 + n_words / greatest(n_lines, 1))",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
    "long_words": "sqrt(n_long / greatest(n_words, 1))",
}
NAMES = list(STATISTICS)


def measured(counts: DataFrame) -> DataFrame:
    """Counts with one double column per statistic."""
    return counts.select(*[c for c in counts.columns if c not in NAMES], *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


def isotonic(score: np.ndarray, label_sum: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling adjacent violators; knots and values for interpolation."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, y, w in zip(score[order], label_sum[order], weight[order]):
        pools.append([s * w, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array(pools)
    return at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]


class FourierRidge:
    """The fitted model: bounded in size, so it travels with the task."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, bandwidth: float, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = draw.normal(size=(len(mean), features)) / bandwidth
        self.shift = draw.uniform(0, 2 * np.pi, features)
        self.weights: np.ndarray | None = None
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, rows: pd.DataFrame) -> np.ndarray:
        x = np.clip((rows[NAMES].to_numpy(float) - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, rows: pd.DataFrame) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        return np.clip(self.features(rows) @ self.weights, -1, 2)

    def score(self, rows: pd.DataFrame) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), *self.knots), 0, 1)


def fit(counts: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, bandwidth: float = 3.0, ridge: float = 1e-3, seed: int = 11, parts: int = 32) -> FourierRidge:
    """``counts`` feed the standardisation, ``labels`` the fit; ``parts`` bounds how many partial sums are shuffled."""
    stats = measured(counts)
    moments = stats.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in NAMES for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[f"avg_{n}"] or 0.0 for n in NAMES])
    scale = np.array([moments[f"stddev_pop_{n}"] or 1.0 for n in NAMES])
    model = FourierRidge(mean, scale, features, bandwidth, seed)
    train = cut_lineage(labelled(stats, labels, label).withColumn("__fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))).select(*NAMES, "__label", "__fold"))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for rows in frames:
            if len(rows):
                x = model.features(rows)
                total += x.T @ np.hstack([x, rows[["__label"]].to_numpy(float)])
        yield pd.DataFrame({"line": range(features + 1), "partial": list(total)})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [key[0]], "partial": [np.sum(np.stack(rows.partial), axis=0)]})

    partial = train.filter("__fold > 0").repartition(parts).mapInPandas(sums, "line int, partial array<double>")
    lines = partial.groupBy("line").applyInPandas(add, "line int, partial array<double>").orderBy("line").collect()  # features + 1 rows
    whole = np.array([r.partial for r in lines])
    rows_seen = whole[-1, -2]
    if not rows_seen:
        return model
    share = whole[-1, -1] / rows_seen
    gram, right = whole[:, :-1], whole[:, -1]
    penalty = np.full(features + 1, ridge * rows_seen)
    penalty[-1] = 0.0
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                yield pd.DataFrame({"bin": np.round(model.raw(rows), 3), "y": rows["__label"].to_numpy()})

    bins = (
        train.filter("__fold = 0").mapInPandas(binned, "bin double, y int").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    )  # at most 3,001 bins
    model.knots = isotonic(bins.bin.to_numpy(), bins.y.to_numpy(float), bins.n.to_numpy(float)) if len(bins) else (np.array([0.0]), np.array([share]))
    return model


def score(docs: DataFrame, labels: DataFrame, teach: Callable[[str], Column], label: str = "quality", **options) -> DataFrame:
    """Score every document; only label rows for which ``teach('doc_id')`` holds are learned from."""
    counts = cut_lineage(document_counts(docs))
    model = fit(counts, labels.filter(teach("doc_id")), label, **options)
    stats = measured(counts)
    columns = ["doc_id", *NAMES]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": model.score(rows) if len(rows) else np.zeros(0)})

    kind = counts.schema["doc_id"].dataType.simpleString()
    scored = stats.select(*columns).mapInPandas(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
