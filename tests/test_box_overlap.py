"""The union of a hot group's boxes against a grid of unit cells."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import spatial


def test_hot_group(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for g, n in (("hot", 6000), ("small", 5), (None, 40)):
        for _ in range(n):
            x, y = rng.randrange(900), rng.randrange(900)
            rows.append((g, x, y, x + rng.randrange(12), y + rng.randrange(12)))
        rows += rows[-3:]
    df = spark.createDataFrame(rows, "g string, x0 int, y0 int, x1 int, y1 int")
    area = spatial.covered_area

    def bounded(rings, *box):
        held = F.when(F.size(rings) > spatial.DENSE, F.raise_error(F.lit("too many boxes in a row")).cast("double"))
        return F.coalesce(held, area(rings, *box))

    monkeypatch.setattr(spatial, "covered_area", bounded)
    got = {r.g: r for r in spatial.box_overlap(df, "g").collect()}
    for g in ("hot", "small", None):
        grid, total = np.zeros((920, 920), dtype=bool), 0
        for h, x0, y0, x1, y1 in rows:
            if h == g:
                grid[y0:y1, x0:x1] = True
                total += (x1 - x0) * (y1 - y0)
        assert got[g].total == total and abs(got[g].united - grid.sum()) < 1e-6
        assert abs(got[g].overlap_fraction - (1 - grid.sum() / total)) < 1e-9
