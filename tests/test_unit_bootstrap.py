"""The bootstrap over units in small blocks, bands and chunks against brute force, and its joins."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import metrics, unit_bootstrap


def test_blocks_bands_and_chunks(spark, monkeypatch):
    for name, value in (("UNITS", 8), ("DRAWS", 500), ("BAND_ROWS", 60), ("ROWS", 37), ("CHUNK", 13)):
        monkeypatch.setattr(unit_bootstrap, name, value)
    monkeypatch.setattr("tessella.operators.ranking.SAMPLE", 50)
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(40)}", rng.choice([0.4, 0.5, rng.randrange(100) / 100]), rng.choice([0, 0, 1, 1, None])) for _ in range(900)]
    rows += [(None, 0.7, 1), ("u3", None, 1), ("u3", float("nan"), 0), ("empty", None, 1)]
    units = sorted({u for u, *_ in rows}, key=lambda u: (u is not None, u))
    kept = [r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1] and r[2] is not None]
    at, prob, y = np.array([units.index(u) for u, *_ in kept]), np.array([p for _, p, _ in kept]), np.array([y for *_, y in kept])
    found = []
    for rep in range(30):
        drawn = [int(hashlib.md5(f"5:{rep}:{k}".encode()).hexdigest()[:8], 16) % len(units) for k in range(len(units))]
        w = np.bincount(drawn, minlength=len(units))[at]
        pos, hit = (w * y).sum(), (w * y * (prob >= 0.4)).sum()
        ap = 0.0
        for p in np.unique(prob):
            up = w * (prob >= p)
            ap += (w * y * (prob == p)).sum() / pos * ((up * y).sum() / up.sum() if up.sum() else 0)
        found.append((ap, 2 * hit / (pos + (w * (prob >= 0.4)).sum()), hit / pos))
    low, high = np.percentile(np.array(found), [2.5, 97.5], axis=0)
    df = spark.createDataFrame(rows, "unit string, prob double, y int").repartition(3)
    got = {r.metric: r for r in metrics.bootstrap_interval(df, "unit", 0.4, 30, 5).collect()}
    for k, m in enumerate(("average_precision", "f1", "recall")):
        assert got[m].n_usable == 30 and abs(got[m].low - low[k]) < 1e-9 and abs(got[m].high - high[k]) < 1e-9


def test_draws_are_exchanged(spark):
    """However few rows Spark expects, the draws of all units don't go through the driver."""
    units = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("unit"), F.col("id").alias("k"))
    plan = unit_bootstrap.draw_vectors(units, 5000, 20, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
