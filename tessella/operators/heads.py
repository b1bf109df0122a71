"""A logistic head over pooled embeddings, trained on batches of forced ratio, with early stopping on validation.

Each epoch deals its batches anew.  They are dealt on to a fixed number of
shards, each of which goes through its batches one after the other (decoupled
weight decay, adaptive rates), streaming, from the same state; the states are
then averaged, weighted by their batches.  What reaches the driver is one state
of a few numbers for each shard, and the validation's average precision, which
Spark computes over all its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import metrics, sampling
from tessella.session import can_checkpoint


@dataclass
class Head:
    weights: list[float]
    bias: float
    best_epoch: int = 0
    best_average_precision: float = -1.0
    early_stopped: bool = False
    epochs: list[dict] = field(default_factory=list)

    def probability(self, vector: str) -> Column:
        dot = F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, self.weights)), lambda x, w: x.cast("double") * w), F.lit(self.bias), lambda s, v: s + v)
        return 1 / (1 + F.exp(-dot))


def adam_steps(state: dict[str, np.ndarray], batches, rate: float, decay: float) -> tuple[dict[str, np.ndarray], int, float]:
    """Go through batches of (vectors with a last 1, targets); gives the state, the number of batches and the sum of their losses."""
    w, m, v, t = (state[k].copy() for k in ("w", "m", "v", "t"))
    n, loss = 0, 0.0
    for x, y in batches:
        z = x @ w
        p = 1 / (1 + np.exp(-z))
        loss += float(np.mean(np.logaddexp(0.0, z) - y * z))
        g = x.T @ (p - y) / len(y)
        t += 1
        w *= 1 - rate * decay
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        n += 1
    return {"w": w, "m": m, "v": v, "t": t}, n, loss


def _shard(state: dict[str, np.ndarray], rate: float, decay: float):
    def of_batches(rows):
        """Whole batches of a stream of rows that come in their order."""
        held: list[pd.DataFrame] = []
        for r in rows:
            for _, part in r.groupby("batch", sort=True):
                if held and held[0]["batch"].iloc[0] != part["batch"].iloc[0]:
                    yield pd.concat(held)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held)

    def run(frames):
        now, shard, n, loss = state, None, 0, 0.0
        for b in of_batches(frames):
            if b["shard"].iloc[0] != shard:
                if shard is not None:
                    yield pd.DataFrame({"shard": [shard], "n": [n], "loss": [loss], **{k: [x.tolist()] for k, x in now.items()}})
                now, shard, n, loss = state, b["shard"].iloc[0], 0, 0.0
            x = np.column_stack((np.stack(b["vector"].to_numpy()), np.ones(len(b))))
            now, _, more = adam_steps(now, [(x, b["y"].to_numpy(dtype=float))], rate, decay)
            n, loss = n + 1, loss + more
        if shard is not None:
            yield pd.DataFrame({"shard": [shard], "n": [n], "loss": [loss], **{k: [x.tolist()] for k, x in now.items()}})

    return run


def train_head(
    train: DataFrame, val: DataFrame, key: str = "tile_id", vector: str = "pooled", y: str = "y", *, batch_size: int = 64, fraction: float = 0.25, epochs: int = 30, patience: int = 5,
    batches: int | None = None, mining: tuple[int, float, float] | None = None, rate: float = 1e-3, decay: float = 0.01, seed: int = 42, shards: int = 8,
) -> tuple[Head, DataFrame]:
    """The head of the best validation average precision, and the log of all batches (epoch, batch, counts).

    ``mining`` (epochs before, share of negatives that are hard, share of a
    batch's negatives from them) draws hard negatives by the head's own scores
    once the first epochs are over.  Training ends when the precision hasn't
    risen for ``patience`` epochs.  A validation of one class is an error.
    """
    can_checkpoint(train.sparkSession)
    rows = train.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("vector"), F.col(y).cast("int").alias("y")).checkpoint()
    first = rows.select(F.size("vector").alias("d")).first()
    if first is None:
        raise ValueError("no rows to train on")
    size = first.d + 1
    state = {"w": np.zeros(size), "m": np.zeros(size), "v": np.zeros(size), "t": np.zeros(1)}
    best, hard, logs, waited = Head([], 0.0), None, [], 0
    checked = val.select(F.col(vector).cast("array<double>").alias("vector"), F.col(y).cast("int").alias("y"))
    for epoch in range(1, epochs + 1):
        if mining and epoch == mining[0] + 1:
            scored = rows.filter("y = 0").withColumn("__score", Head(state["w"][:-1].tolist(), float(state["w"][-1])).probability("vector"))
            hard = sampling.hard_pool(scored, "__score", "__key", mining[1]).select("__key").checkpoint()
        dealt = sampling.ratio_batches(rows.select("__key", "y"), batch_size, fraction, batches, seed + 1000 * epoch, "__key", "y", hard, mining[2] if hard is not None else 0.0).checkpoint()
        logs.append(sampling.composition(dealt, ["batch"], "y").select(F.lit(epoch).alias("epoch"), "*"))
        fed = dealt.select("batch", "__key").join(rows, "__key").withColumn("shard", F.pmod("batch", F.lit(shards)).cast("int"))
        fed = fed.repartition(shards, "shard").sortWithinPartitions("shard", "batch", "__key").select("shard", F.col("batch").cast("long").alias("batch"), "vector", "y")
        kind = "shard int, n long, loss double, w array<double>, m array<double>, v array<double>, t array<double>"
        ends = fed.mapInPandas(_shard(state, rate, decay), kind).collect()  # a state for each shard
        total = sum(r.n for r in ends)
        state = {k: sum(r.n * np.array(r[k]) for r in sorted(ends)) / total for k in ("w", "m", "v", "t")}
        head = Head(state["w"][:-1].tolist(), float(state["w"][-1]))
        prob = head.probability("vector")
        score = metrics.ranking_scores(checked.select("y", prob.alias("prob")), []).first()
        ap = score.average_precision if score else None
        improved = ap is not None and not math.isnan(ap) and ap > best.best_average_precision
        history = [*best.epochs, {"epoch": epoch, "train_loss": sum(r.loss for r in ends) / total, "n_batches": total, "val_average_precision": ap, "val_roc_auc": score.roc_auc if score else None, "mining_active": hard is not None}]
        if improved:
            best, waited = Head(head.weights, head.bias, epoch, ap, False, history), 0
        else:
            best.epochs, waited = history, waited + 1
            if waited >= patience:
                best.early_stopped = True
                break
    if not best.best_epoch:
        raise ValueError("the validation's average precision never rose: it needs rows of both classes")
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more, allowMissingColumns=True)
    return best, log
