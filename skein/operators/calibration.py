"""Confidence of answers: baselines and a logistic calibrator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Stable on both sides."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def baselines(top1: Column, margin: Column, valid: Column, present: Column, supported: Column, conflict: Column) -> dict[str, Column]:
    composed = 0.45 * top1 + 0.25 * margin + 0.15 * valid + 0.10 * present + 0.05 * supported - 0.25 * conflict
    return {"constant": F.lit(0.5), "top1": clamp(top1), "margin": clamp(margin), "hand_composed": clamp(composed)}


class LogisticCalibrator:
    """Logistic regression by full-batch gradient descent with L2 on the weights, not the intercept.

    Each step's gradient is a sum over rows, of which equal ones are counted together. Up to COLLECT
    different rows are collected once; beyond, the sums are Spark aggregations over a cached table, one job a step.
    """

    COLLECT = 2_000_000

    def __init__(self, features: list[str], epochs: int = 400, rate: float = 0.1, l2: float = 0.01):
        self.features, self.epochs, self.rate, self.l2 = features, epochs, rate, l2
        self.weights, self.intercept = np.zeros(len(features)), 0.0

    def fit(self, rows: DataFrame, target: str) -> LogisticCalibrator:
        names = [*self.features, "_y"]
        data = rows.select(*[F.col(f).cast("double") for f in self.features], F.col(target).cast("double").alias("_y")).groupBy(*names).agg(F.count("*").cast("double").alias("_n")).persist()
        try:
            different, n = data.agg(F.count("*"), F.sum("_n")).first()
            if not n:
                raise ValueError("no rows to fit on")
            if different <= self.COLLECT:
                a = np.column_stack([c.to_numpy() for c in data.toArrow().columns])
                x, y, w = a[:, :-2], a[:, -2], a[:, -1] / n
                for _ in range(self.epochs):
                    e = (1 / (1 + np.exp(-(x @ self.weights + self.intercept))) - y) * w
                    self._step(x.T @ e, e.sum())
                return self
            for _ in range(self.epochs):
                e = (self.predict() - F.col("_y")) * F.col("_n")
                g = data.select(*[F.sum(e * F.col(f)) for f in self.features], F.sum(e)).first()
                self._step(np.array(g[:-1]) / n, g[-1] / n)
            return self
        finally:
            data.unpersist()

    def _step(self, gw: np.ndarray, gb: float) -> None:
        self.weights = self.weights - self.rate * (gw + self.l2 * self.weights)
        self.intercept -= self.rate * gb

    def predict(self) -> Column:
        z = F.lit(float(self.intercept))
        for w, f in zip(self.weights, self.features):
            z = z + float(w) * F.col(f)
        return sigmoid(z)
