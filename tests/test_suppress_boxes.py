"""Box suppression against a plain loop."""

from __future__ import annotations

import random

from tessella.operators import spatial


def staying(boxes: list[tuple], most: float, larger: float) -> set[int]:
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    kept: list[tuple] = []
    for i, *b in sorted(boxes, key=lambda r: (-area(r[1:]), r[0])):
        shared = [max(0, min(b[2], k[3]) - max(b[0], k[1])) * max(0, min(b[3], k[4]) - max(b[1], k[2])) for k in kept]
        if not any(area(k[1:]) >= larger * area(b) and area(b) and s / area(b) >= most for k, s in zip(kept, shared)):
            kept.append((i, *b))
    return {k[0] for k in kept}


def test_boxes_go_only_in_much_larger_ones(spark):
    rng = random.Random(6)
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 7.0), (3, 3.0, 0.0, 13.0, 4.0), (4, 5.0, 5.0, 5.0, 5.0)]
    rows += [(10 + i, x := float(rng.randrange(100)), y := float(rng.randrange(100)), x + rng.randrange(60), y + rng.randrange(60)) for i in range(80)]
    boxes = spark.createDataFrame([("a", *r) for r in rows], "g string, id long, x0 double, y0 double, x1 double, y1 double")
    for larger in (1.0, 2.0):
        got = {r.id for r in spatial.suppress_boxes(boxes, "g", 0.7, larger).collect()}
        assert got == staying(rows, 0.7, larger)


def test_a_crowded_group(spark):
    """Many boxes in few places, with chains of boxes in each other, at shares over and under a half."""
    rng = random.Random(2)
    rows = []
    for i in range(700):
        x, y, w = rng.gauss(50, 8), rng.gauss(50, 8), 2 ** rng.uniform(-1, 6)
        rows.append((i, x, y, x + w, y + w * 2 ** rng.uniform(-1, 1)))
    boxes = spark.createDataFrame([("a", *r) for r in rows] + [(None, *r) for r in rows[:50]], "g string, id long, x0 double, y0 double, x1 double, y1 double")
    for most in (0.7, 0.3):
        got = spatial.suppress_boxes(boxes, "g", most, 2.0).collect()
        assert {r.id for r in got if r.g == "a"} == staying(rows, most, 2.0)
        assert {r.id for r in got if r.g is None} == staying(rows[:50], most, 2.0)
