"""Labelled rows for training, and calibration of scores to probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ship

ship(__name__)


def held_out(mod: int, rest: int) -> Column:
    """crc32 of the doc_id as text leaves this remainder; a null doc_id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def sample(spark: SparkSession, labels: DataFrame, label: str, kept_out: Column, most: int) -> DataFrame:
    """doc_id and y (0, 1) of about ``most`` training rows of each class at most: those of the smallest hashes.

    doc_ids with several labels take the largest; null ids and labels are left out. The
    bound makes the sample fit for broadcast.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~kept_out)
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).filter("y IN (0, 1)")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights of the columns of x, the constant last, by damped Newton steps. Of one class only, a constant near it."""
    if len(set(y.tolist())) < 2:
        return np.append(np.zeros(x.shape[1]), 3.0 if len(y) and y[0] == 1 else -3.0)
    mid, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mid) / spread, np.ones(len(x))])
    hold = ridge * np.eye(z.shape[1])
    hold[-1, -1] = 1e-6

    def loss(w):
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + w @ hold @ w / 2

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + hold @ w
        step, size = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + hold, slope), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if abs(now - (now := loss(w))) < 1e-9 * len(y):
            break
    own = w[:-1] / spread
    return np.append(own, w[-1] - own @ mid)


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
