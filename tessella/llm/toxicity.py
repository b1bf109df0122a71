"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, word pairs and pairs with one word between,
hashed to 2^18 coordinates; presence counts, not number, and long texts aren't
scaled down, so that a few words weigh the same in a text of any length.  Training follows per-coordinate rates with L1 and L2 terms, so most
weights are exactly zero and what is broadcast is a short list of (coordinate,
weight).  Each round, every partition of the training rows starts from the
common state and works through its own rows; the states are then averaged by
coordinate, so no task or driver sees all rows.

Training uses a bounded sample, about MOST_ROWS labelled rows by a hash
of their id, that is, independent of how the table is stored.  Everything else
reads all rows.  Scores see the text alone.  Null and empty texts have no
features and get the score of the bias.  Repeated rows score alike, and so do
texts of any length with the same features; whole texts are read, one at a time.
An empty table gives no rows; without labelled rows every score is 0.5.  Labels
other than 0 and 1 are none; of several for one document the largest counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary, column, fresh, kept

BITS = 18
SIZE = 1 << BITS
#: Labelled rows that training takes at most.
MOST_ROWS = 20_000
#: Partitions that train apart in each round.
SHARDS = 6
#: Of a feature that a text has.
VALUE = 0.5

WORDS = re.compile(rb"[a-z0-9\x80-\xff']+")
STATE = pa.schema([("coordinate", pa.int64()), ("z", pa.float64()), ("n", pa.float64())])


@dataclass(frozen=True)
class Rates:
    """alpha and beta set the per-coordinate rates; l1 and l2 the penalties; epochs the passes over each shard."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 0.01
    rounds: int = 4
    epochs: int = 2


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text's words, pairs and skip-pairs; coordinate 0 is the bias."""
    found = WORDS.findall(text.lower())
    w = np.fromiter(map(zlib.crc32, found), dtype=np.uint64, count=len(found))
    mixed = [w, (w[:-1] * np.uint64(0x9E3779B1) + w[1:] * np.uint64(0x85EBCA77)), (w[:-2] * np.uint64(0xC2B2AE3D) + w[2:] * np.uint64(0x27D4EB2F))]
    h = np.concatenate(mixed)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    kinds = np.repeat(np.arange(3, dtype=np.uint64), [len(x) for x in mixed])
    at = ((h >> np.uint64(64 - BITS)) ^ (kinds * np.uint64(0x15555))).astype(np.int64)
    at[at == 0] = 1
    at.sort()
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    at = np.concatenate(([0], at))
    return at, np.full(len(at), VALUE)


def weights(z: np.ndarray, n: np.ndarray, r: Rates) -> np.ndarray:
    """The closed form: zero within the L1 bound."""
    return np.where(np.abs(z) <= r.l1, 0.0, -(z - np.sign(z) * r.l1) / ((r.beta + np.sqrt(n)) / r.alpha + r.l2))


def ftrl(z: np.ndarray, n: np.ndarray, rows: list, r: Rates) -> None:
    """One pass over (coordinates, values, label), in place."""
    for at, x, y in rows:
        w = weights(z[at], n[at], r)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / r.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def _pass(state, r: Rates):
    def run(batches):
        kept("toxicity")
        z, n = (x.copy() for x in dense(state.value))
        rows = []
        for batch in batches:
            rows += [(*features(t), y) for t, y in zip(binary(batch, "text"), column(batch, "y").to_pylist())]
        if rows:
            for _ in range(r.epochs):
                ftrl(z, n, rows, r)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(z[at]), pa.array(n[at])], schema=STATE)

    return run


def dense(state: tuple) -> tuple[np.ndarray, np.ndarray]:
    at, *values = state
    out = []
    for v in values:
        full = np.zeros(SIZE)
        full[at] = v
        out.append(full)
    return tuple(out)


def sampled_marks(labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Columns doc_id, y of the labelled rows that may be learnt from: about ``most_rows`` by a hash of the id, 1.2 times that at most."""
    marks = labels.filter(~held_out()).filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = most_rows / max(1, marks.count())
    if share >= 1:
        return marks
    return marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(int(1.2 * most_rows))


def train(labelled: DataFrame, r: Rates = Rates()) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights, as (coordinates, values), from columns text and y (0 or 1); the rows are a bounded sample.

    The driver holds three numbers for each of 2^18 coordinates at most.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("y").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("double").alias("y"))
    rows = rows.repartition(SHARDS).sortWithinPartitions(F.xxhash64("text", F.lit(1)), "y").cache()  # as many shards at any size
    state = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    try:
        for _ in range(r.rounds):
            sent = spark.sparkContext.broadcast(state)
            out = rows.mapInArrow(_pass(sent, r), "coordinate long, z double, n double")
            mean = out.groupBy("coordinate").agg(F.sum("z").alias("z"), F.avg("n").alias("n"), F.count(F.lit(1)).alias("k")).toArrow()
            sent.destroy()
            if not mean.num_rows:
                break
            k = mean["k"].to_numpy().max()
            state = (mean["coordinate"].to_numpy(), mean["z"].to_numpy() / k, mean["n"].to_numpy())
    finally:
        rows.unpersist()
    w = weights(state[1], state[2], r)
    return state[0][w != 0], w[w != 0]


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` and one more, last column ``score`` (with underscores before it where ``docs`` has one), computed from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(fresh(docs, "score"), _scorer(sent)(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _scorer(sent):
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("toxicity")
        (w,) = dense(sent.value)
        for texts in parts:
            yield pd.Series([sigmoid(w, t) for t in texts], dtype="float64")

    return score


def sigmoid(w: np.ndarray, text: bytes) -> float:
    at, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))))


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnt_scores(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), most_rows: int = MOST_ROWS) -> DataFrame:
    """``docs`` and one more, last column with the score of a model learnt from the labelled rows that aren't held out."""
    marks = F.broadcast(sampled_marks(labels, most_rows))  # 1.2 times most_rows rows at most
    model = train(docs.select("doc_id", "text").join(marks, "doc_id"), rates)
    return toxicity_scores(docs, model)


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = learnt_scores(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
