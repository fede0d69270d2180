"""Bounded labelled samples and small numeric fits, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Grains of the hash by which rows are sampled.
GRAINS = 1 << 30


def sample_by_class(df: DataFrame, label: str, keys: Sequence[str], per_class: int, seed: int = 5) -> DataFrame:
    """About ``per_class`` distinct rows of each class at most, by a hash of ``keys``; rows without a class go.

    Rows that agree in ``keys`` and class count once, so that the bound holds whatever repeats.  One
    aggregation learns how many there are of a class; nothing is ordered, no class meets in one
    task, and reruns agree.
    """
    hashed = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    marked = df.where(F.col(label).isNotNull()).withColumn("__h", hashed)
    counts = {r[0]: r[1] for r in marked.groupBy(label).agg(F.approx_count_distinct("__h", 0.01).alias("n")).collect()}  # one row per class
    kept = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        kept = kept | ((F.col(label) == F.lit(value)) & (F.pmod("__h", F.lit(GRAINS)) < int(min(1.0, per_class / max(1, n)) * GRAINS)))
    return marked.where(kept).dropDuplicates(["__h", label]).drop("__h")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, name: str) -> DataFrame:
    """Staged doc_id, text and ``label`` of about ``per_class`` labelled rows of each class at most.

    Sampled twice: first the ids that labels name, then the rows of ``docs`` that stand under them.
    """
    chosen = sample_by_class(labels.where(F.col(label).isin(0, 1)).select("doc_id", label), label, ["doc_id"], per_class)
    # at most about 2 * per_class ids, so the broadcast is bounded
    met = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), name)
    out = staged(sample_by_class(met, label, ["doc_id", "text"], per_class), name)
    discard(met)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights and a last intercept, by Newton steps with a small ridge; features are standardised within."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = w.copy()
    out[:-1] /= spread
    out[-1] -= (w[:-1] / spread * mean).sum()
    return out


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> np.ndarray:
    """A linear support vector machine (squared hinge, y in -1, 1) on ``x[rows]``, by conjugate gradients; the intercept is last.

    Matrix products keep the width of ``x``'s numbers, so one copy of the rows is all the memory.
    """
    z = x[rows]
    weight = c / np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])[(y > 0).astype(int)]

    def times(w: np.ndarray) -> np.ndarray:
        return z @ w[:-1].astype(z.dtype) + w[-1]

    w = np.zeros(z.shape[1] + 1)
    before, direction = None, None
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * times(w))
        pull = weight * slack * y
        slope = w - 2 * np.append(pull.astype(z.dtype) @ z, pull.sum())
        new = float(slope @ slope)
        if new < 1e-10:
            break
        direction = -slope if before is None else -slope + new / before * direction
        if slope @ direction >= 0:
            direction = -slope
        curve = float(direction @ direction) + 2 * float(((slack > 0) * weight) @ times(direction) ** 2)
        w = w - (slope @ direction) / curve * direction
        before = new
    return w


def ragged_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], in doubles; empty runs give 0."""
    out = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some], dtype=np.float64)
    return out
