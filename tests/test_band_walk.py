"""Bands of the bootstrap are walked a few rows at a time: any cut of the rows gives the same, and no task holds a band."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import unit_bootstrap as U


def band_rows(rng, replicates):
    """Two bands with their heads, many rows at one probability, and what their scores add up to."""
    rows, want = [], np.zeros(replicates)
    for band in (3, 1):
        sums = rng.integers(0, 50, (6, replicates))
        probs = np.sort(np.concatenate((np.full(40, 0.5), rng.random(30))))[::-1] + 0.0
        kinds, weights = rng.integers(0, 3, len(probs)), rng.poisson(1, (len(probs), replicates)) * rng.choice([1, 300], (len(probs), 1))
        sums[4] = sums[1] + (weights * (kinds == 1)[:, None]).sum(axis=0) + 7
        rows += [(band, None, first, sums[:, first : first + 4].astype(np.int64).tobytes()) for first in range(0, replicates, 4)]
        rows += [(band, p, int(k), U.packed(w)) for p, k, w in zip(probs, kinds, weights)]
        for p in np.unique(probs):
            up, at = probs >= p, probs == p
            tp, fp = (sums[k] + (weights[up] * (kinds[up] == k)[:, None]).sum(axis=0) for k in (1, 0))
            want += (weights[at] * (kinds[at] == 1)[:, None]).sum(axis=0) / np.maximum(1, sums[4]) * tp / np.maximum(1, tp + fp)
    return rows, want


@pytest.mark.parametrize("step, rows_at_once", [(1, 500), (7, 500), (1000, 500), (1000, 1), (13, 5)])
def test_any_batches(monkeypatch, step, rows_at_once):
    monkeypatch.setattr(U, "ROWS", rows_at_once)
    rows, want = band_rows(np.random.default_rng(4), 10)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + step]], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int32(), pa.binary()))], names=["band", "prob", "kind", "weights"]) for i in range(0, len(rows), step)]
    (got,) = U._walked(10)(iter(batches))
    assert got.column("rep").to_pylist() == list(range(10)) and np.allclose(got.column("score").to_numpy(), want, rtol=0, atol=1e-9)


def test_no_task_holds_a_band(spark):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(9)}", rng.choice([0.5, rng.random()]), rng.randrange(3), True, 1) for _ in range(300)]
    ties = spark.createDataFrame(rows, "unit string, prob double, kind int, hit boolean, c long")
    found = U.unit_scores(ties, ties.select("unit").distinct(), "unit", 20, 7)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString() and found.filter(F.col("average_precision") > 0).count() == 20
