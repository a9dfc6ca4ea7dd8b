"""Training of a linear head on propagated features: losses and gradients are sums over rows, so each step is one aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSSES = ("softmax", "squared", "absolute")


@dataclass
class Head:
    """``weights`` and ``bias`` of the best epoch (by validation loss where there is any), and the losses of all epochs."""

    weights: np.ndarray
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)
    best: int = 0


def loss_and_slope(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Sum of the losses of rows, and its slope in ``z``. softmax: ``y`` are class numbers; else targets of ``z``'s shape."""
    if loss == "softmax":
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        at = np.arange(len(y)), y.astype(int)
        total = -float(np.log(np.maximum(p[at], 1e-300)).sum())
        p[at] -= 1
        return total, p
    gap = z - y
    return (float(np.square(gap).sum()), 2 * gap) if loss == "squared" else (float(np.abs(gap).sum()), np.sign(gap))


def step_sums(rows: DataFrame, w: np.ndarray, b: np.ndarray, loss: str) -> dict[str, tuple[np.ndarray, float, int]]:
    """For each ``part`` the gradient, the loss and the number of rows, summed by entry in Spark: no task's gradient comes to the driver."""
    size = (w.shape[0] + 1) * w.shape[1]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for part, own in f.groupby("part"):
                x = np.stack(own["features"].to_numpy())
                y = own["label"].to_numpy() if loss == "softmax" else np.stack(own["label"].to_numpy())
                total, slope = loss_and_slope(x @ w + b, y, loss)
                g = np.append(np.vstack([x.T @ slope, slope.sum(0)]).ravel(), [total, len(own)])
                sums[part] = sums.get(part, 0) + g
        yield pd.DataFrame({"part": list(sums), "g": [g.tolist() for g in sums.values()]})

    each = rows.mapInPandas(partial, "part string, g array<double>").select("part", F.posexplode("g").alias("at", "g"))
    out: dict[str, np.ndarray] = {}
    for r in each.groupBy("part", "at").agg(F.sum("g").alias("g")).collect():  # a row for each weight and part
        out.setdefault(r["part"], np.zeros(size + 2))[r["at"]] = r["g"]
    return {part: (g[:size].reshape(w.shape[0] + 1, -1), float(g[size]), int(g[size + 1])) for part, g in out.items()}


def train_head(rows: DataFrame, outputs: int, loss: str = "softmax", epochs: int = 50, rate: float = 0.5, decay: float = 1e-4, patience: int | None = None, seed: int | None = None) -> Head:
    """A linear head by Adam on whole-table gradients of ``rows``: ``features``, ``label``, and maybe ``part``.

    Labels are class numbers (softmax) or arrays of ``outputs`` numbers (squared, absolute). Rows of the part ``train`` (all
    without a ``part`` column) are learned from, those of ``valid`` tell the best epoch, all others (masked ones, a null part)
    are left out. With ``patience`` training ends after so many epochs without a better validation loss.
    """
    if loss not in LOSSES:
        raise ValueError(f"a loss is one of {', '.join(LOSSES)}")
    kept = rows if "part" in rows.columns else rows.withColumn("part", F.lit("train"))
    kept = kept.filter(F.col("part").isin("train", "valid")).select("features", "label", "part")
    first = kept.select(F.size("features").alias("n")).first()
    if first is None:
        raise ValueError("there is nothing to learn from")
    w, b = np.zeros((first["n"], outputs)), np.zeros(outputs)
    if seed is not None:
        r = np.sqrt(1 / (first["n"] * outputs))
        w = np.random.default_rng(seed).uniform(-r, r, w.shape)
    m, v = np.zeros((len(w) + 1, outputs)), np.zeros((len(w) + 1, outputs))
    head, least = Head(w, b), np.inf
    for t in range(1, epochs + 1):
        sums = step_sums(kept, w, b, loss)
        g, total, n = sums.get("train", (np.zeros_like(m), 0.0, 0))
        head.losses.append(total / max(1, n))
        _, over, asked = sums.get("valid", (None, 0.0, 0))
        now = over / asked if asked else head.losses[-1]
        if asked:
            head.validation.append(now)
        if now < least:
            least, head.best, head.weights, head.bias = now, t, w.copy(), b.copy()
        elif patience is not None and t - head.best >= patience:
            break
        g = g / max(1, n)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return head


def softmax_head(rows: DataFrame, classes: int, epochs: int = 50, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights, bias and losses of a linear softmax classifier over rows (``features``, ``label``)."""
    head = train_head(rows, classes, "softmax", epochs, rate, decay)
    return head.weights, head.bias, head.losses
