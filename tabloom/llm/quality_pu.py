"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good outside the held-out fold; the unlabelled side is all documents, whatever
their label.  A logistic model is fitted to the non-negative unbiased risk

    prior * E_positive[loss(f)] + max(0, E_unlabelled[loss(-f)] - prior * E_positive[loss(-f)])

by Newton steps whose sums run over all rows on the executors.  The class prior is estimated from the data: a scorer of
positives against unlabelled is histogrammed, and the prior is the smallest ratio of the unlabelled to the positive mass
above a score, with the bounds of both samples' errors (every such ratio bounds the prior from above).
"""

from __future__ import annotations

import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import Scratch, held_out, small_batches, summed

THRESHOLD = 0.3
RIDGE, RIDGE_ROWS = 1e-4, 3.0
SCORER_STEPS = 6
RISK_STEPS = 12
BINS = 400
PRIOR_DOUBT = 1.0
# What a document is measured by.
SYMBOLS = b"#*$%&|<>"
NAMES = (
    "one", "log_words", "log_chars", "symbols", "marks", "upper", "digits", "stops", "pipes", "word_length",
    "distinct_words", "distinct_lines", "wide", "lines", "short_words", "caps_words", "any_symbol", "any_mark",
    "same_as_before", "any_same", "richness",
)
WIDTH = len(NAMES)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars, dtype=np.uint8)] = 1
    return out


CLASSES = np.stack(
    [_class(SYMBOLS), _class(b"!?"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:"), _class(b"|"),
     _class(bytes(range(128, 256))), _class(b"\n"), _class(bytes(range(97, 123)))],
    axis=1,
)


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of characters and words of several kinds; an empty text has the constant alone."""
    out = np.zeros(WIDTH, dtype=np.float32)
    out[0] = 1
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return out
    n, size = len(words), len(data)
    symbols, marks, upper, digits, stops, pipes, wide, breaks, lower = np.bincount(
        np.frombuffer(data, dtype=np.uint8), minlength=256
    ) @ CLASSES
    lines = [line for line in data.split(b"\n") if line.strip()]
    kinds, same = len(set(words)), sum(map(operator.eq, words, words[1:])) / n
    out[1:] = (
        np.log1p(n), np.log1p(size), min(symbols / n, 4), min(marks / n, 4), upper / max(1, upper + lower + wide),
        digits / size, min(stops / n, 4), min(pipes / n, 2), min(size / n, 40) / 10, kinds / n,
        len(set(lines)) / max(1, len(lines)), wide / size, min(breaks / n, 1), sum(len(w) < 3 for w in words) / n,
        sum(w[:1].isupper() for w in words) / n, symbols > n / 10, marks > n / 10,
        same, same > 0.1, np.log1p(kinds) / np.log1p(n),
    )
    return out


@F.pandas_udf(T.BinaryType())
def feature_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).tobytes() for t in texts])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(margin / 2))


class Model:
    """Weights over standardised features, as plain arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float) -> None:
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.margin(x))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that every label of quality calls good, outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("good_id"))


def measured(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, x (features), positive."""
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), feature_bytes("text").alias("x"))
    good = trusted(labels)
    return rows.join(good, rows["doc_id"] == good["good_id"], "left").select(
        "doc_id", "held_out", "x", F.col("good_id").isNotNull().alias("positive")
    )


def _newton(rows: DataFrame, model: Model, parts, gradient, steps: int, ridge: float) -> np.ndarray:
    """Weights of the least risk among Newton steps; ``parts`` gives per-row terms, ``gradient`` makes risk, slope and
    curvature of their sums."""
    weights, best = model.weights.copy(), None
    for _ in range(steps):
        now = Model(model.mean, model.scale, weights, model.prior)

        def partial(batch, now=now):
            z = (_matrix(batch["x"]) - now.mean) / now.scale
            positive = batch["positive"].to_numpy(dtype=bool)
            return parts(z, _logistic(z @ now.weights), positive)

        risk, slope, curve = gradient(summed(rows, partial, 2 * (1 + 2 * WIDTH + WIDTH * WIDTH)), weights)
        risk += ridge * weights @ weights / 2
        if best is None or risk < best[0]:
            best = risk, weights
        step = np.linalg.solve(curve + ridge * np.eye(WIDTH), slope + ridge * weights)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    return best[1]


def _side(z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of one class: risk of being called negative, sums of z and of z times its probability, curvature."""
    return np.concatenate([
        [-np.log(np.maximum(1 - p, 1e-300)).sum()], z.sum(axis=0), z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel(),
    ])


def _both_sides(z: np.ndarray, p: np.ndarray, positive: np.ndarray) -> np.ndarray:
    return np.concatenate([_side(z[positive], p[positive]), _side(z, p)])


def _split(sums: np.ndarray, n: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    sums = sums / max(1.0, n)
    return sums[0], sums[1 : 1 + WIDTH], sums[1 + WIDTH : 1 + 2 * WIDTH], sums[1 + 2 * WIDTH :].reshape(WIDTH, WIDTH)


def fit(rows: DataFrame) -> Model:
    """Prior and weights from the measured rows.  Without positives or without rows everything scores one half."""

    def moments(batch):
        x = _matrix(batch["x"])
        return np.concatenate([[len(x), batch["positive"].sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    total = summed(rows, moments, 2 + 2 * WIDTH)
    n, n_positive = total[0], total[1]
    if n == 0 or n_positive == 0:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.5)
    mean = total[2 : 2 + WIDTH] / n
    scale = np.sqrt(np.maximum(total[2 + WIDTH :] / n - mean**2, 0))
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-6] = 1
    model = Model(mean, scale, np.zeros(WIDTH), 0.5)

    def scorer(sums, weights):
        negative_p, mean_p, hit_p, curve_p = _split(sums[: len(sums) // 2], n_positive)
        negative_u, _, hit_u, curve_u = _split(sums[len(sums) // 2 :], n)
        risk = (negative_p - mean_p @ weights + negative_u) / 2
        return risk, (hit_p - mean_p + hit_u) / 2, (curve_p + curve_u) / 2

    ridge = max(RIDGE, RIDGE_ROWS / n_positive)
    model.weights = _newton(rows, model, _both_sides, scorer, SCORER_STEPS, ridge)

    def histogram(batch):
        place = np.minimum((model.score(_matrix(batch["x"])) * BINS).astype(int), BINS - 1)
        positive = batch["positive"].to_numpy(dtype=bool)
        return np.concatenate([np.bincount(place[positive], minlength=BINS), np.bincount(place, minlength=BINS)])

    counts = summed(rows, histogram, 2 * BINS)
    model.prior = estimated_prior(counts[:BINS], counts[BINS:])
    prior = model.prior

    def risk(sums, weights):
        negative_p, mean_p, hit_p, curve_p = _split(sums[: len(sums) // 2], n_positive)
        negative_u, _, hit_u, curve_u = _split(sums[len(sums) // 2 :], n)
        on_positive = prior * (negative_p - mean_p @ weights)
        on_negative = negative_u - prior * negative_p
        slope, curve = prior * (hit_p - mean_p), prior * curve_p
        if on_negative >= 0:  # else that part of the risk stands at its floor of zero
            slope, curve = slope + hit_u - prior * hit_p, curve_u
        return on_positive + max(0.0, on_negative), slope, curve

    model.weights = _newton(rows, model, _both_sides, risk, RISK_STEPS, ridge)
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound of the share of positives: least ratio of tail masses, each moved by its sampling error."""
    tail_p, tail_u = positive[::-1].cumsum()[::-1], unlabelled[::-1].cumsum()[::-1]
    n_p, n_u = max(1.0, tail_p[0]), max(1.0, tail_u[0])
    share_p, share_u = tail_p / n_p, tail_u / n_u
    doubt = PRIOR_DOUBT * (np.sqrt(share_u * (1 - share_u) / n_u) + np.sqrt(share_p * (1 - share_p) / n_p) + 1 / n_p)
    usable = share_p > np.maximum(0.05, 4 * doubt)
    ratio = np.where(usable, (share_u + doubt) / np.where(usable, share_p, 1), 1.0)
    return float(np.clip(ratio.min(), 0.02, 0.98))


def score_column(model: Model) -> Column:
    """Score of a text column, for filters that keep the rows' other columns in the JVM."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, WIDTH)))

    return score("text")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.3 on), prior.

    NULL and empty texts have a score like any text without words; rows without an id count as held out.  Repeated rows are
    scored alike; labels without a document, or NULL, are not used.
    """
    spark = documents.sparkSession
    with Scratch(spark, "quality") as scratch, small_batches(spark):
        rows = scratch.write(measured(documents, labels), keep=True)
        model = fit(rows)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(x)))

    out = rows.select("doc_id", "held_out", score("x").alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.lit(model.prior).alias("prior"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier does not reject."""
    spark = documents.sparkSession
    with Scratch(spark, "quality") as scratch, small_batches(spark):
        model = fit(scratch.write(measured(documents, labels)))
    return documents.where(score_column(model) >= THRESHOLD)
