"""Bounded training samples and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def training_sample(labels: DataFrame, column: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, y): at most ``most`` labelled rows of the usable folds, those of the smallest hash of the id.

    Null ids and labels are left out; of repeated ids the largest label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & usable)
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = chance(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
