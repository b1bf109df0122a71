"""Outlines cut to tiles: each meets its tiles after one exchange, against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import grid, spatial
from tessella.operators.polygon_area import clipped, union_area

OUTLINES = "cut_name string, id string, ring array<struct<x: double, y: double>>, stage int"


def planted() -> tuple[list[tuple], list[tuple]]:
    rng, rows = random.Random(5), []
    cuts = [("a", 900, 700), ("b", 130, 1500), ("small", 40, 30), ("none", 300, 300)]
    for c, w, h in cuts[:3]:
        for i in range(40):
            x, y, s, t = rng.uniform(-60, w), rng.uniform(-60, h), rng.choice([0, 7, 50, 260]), rng.choice([3, 40, 300])
            box = [(x, y), (x + s, y), (x + s, y + t), (x, y + t)]
            odd = [(x, y), (x + s, y + t), (x + s, y), (x, y + t)] if i % 2 else [(x + rng.uniform(0, s + 5), y + rng.uniform(0, t)) for _ in range(rng.choice([2, 3, 7]))]
            rows += [(c, f"r{i}", (box, box[::-1], box[2:] + box[:2], box + box[:1])[i % 4], i), (c, f"o{i}", odd, i)]
    wide = [(-1e9, -1e9), (1e9, -1e9), (1e9, 1e9), (-1e9, 1e9)]
    rows += [("a", "twice", rows[3][2], 1), ("a", "twice", rows[3][2], 1), ("a", "wide", wide, 2), ("a", "null", None, 3), ("gone", "g", wide, 4), ("a", "far", [(5000.0, 5.0), (5100.0, 5.0), (5100.0, 50.0), (5000.0, 50.0)], 5)]
    return cuts, rows


def test_as_by_loops(spark):
    cuts, rows = planted()
    sizes = [64, 100]
    cut = spark.createDataFrame(cuts, "cut_name string, width long, height long")
    tiles = grid.tile_grid(cut, sizes).filter("row + col <> 3")  # any tiles of the grid will do
    want = {}
    boxes = tiles.collect()
    for n, (c, i, ring, stage) in enumerate(rows):
        if ring is None or len(ring) < 3:
            continue
        p = np.array(ring)
        own = union_area([p], *p.min(axis=0), *p.max(axis=0))
        for t in boxes:
            if t.cut_name != c or not own or not (p[:, 0].min() < t.x1 and p[:, 0].max() > t.x0 and p[:, 1].min() < t.y1 and p[:, 1].max() > t.y0):
                continue
            cut_ring = clipped(p, t.x0, t.y0, t.x1, t.y1)
            share = union_area([cut_ring], t.x0, t.y0, t.x1, t.y1) / own
            assert abs(share - 0.3) > 1e-9
            if share >= 0.3:
                want.setdefault((c, t.tile_size, t.row, t.col, i, stage), []).append((share, p if t.x0 <= p[:, 0].min() and p[:, 0].max() <= t.x1 and t.y0 <= p[:, 1].min() and p[:, 1].max() <= t.y1 else cut_ring))
    got = {}
    for r in spatial.clipped_instances(tiles, spark.createDataFrame(rows, OUTLINES), cut, sizes).collect():
        got.setdefault((r.cut_name, r.tile_size, r.row, r.col, r.id, r.stage), []).append((r.visible, np.array([(q.x, q.y) for q in r.ring])))
    assert got.keys() == want.keys() and len(got) > 100
    for k in want:
        assert len(got[k]) == len(want[k])
        for (v, ring), (w, other) in zip(got[k], want[k]):
            assert abs(v - w) < 1e-9 and ring.shape == other.shape and np.allclose(ring, other, rtol=0, atol=0)


def test_outlines_are_exchanged_once(spark, tmp_path):
    """Not once for each tile that shows them, nor for each of four ways; rectangles go without points, and not through Python."""
    cuts = spark.range(50).select(F.concat(F.lit("P"), "id").alias("cut_name"), F.lit(2000).cast("long").alias("width"), F.lit(1500).cast("long").alias("height"))
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    cuts.select("cut_name", F.col("cut_name").alias("id"), F.array(p(400, 9), p(460, 9), p(460, 60), p(400, 60)).alias("ring")).write.parquet(str(tmp_path / "o"))
    found = spatial.clipped_instances(grid.tile_grid(cuts, [512]), spark.read.parquet(str(tmp_path / "o")), cuts, [512])
    counts = found.groupBy("tile_size").agg(F.sum("visible"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\((?:cut_name|__cut)#", plan)) == 4  # outlines and tiles, rectangles and others
    assert "Python" not in plan[: plan.index("SortMergeJoin")]
