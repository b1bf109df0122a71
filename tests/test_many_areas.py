"""Areas of many rows at a time against sweeps of each by itself."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tessella.operators import polygon_area


def columns(rows):
    part = lambda a: pa.array([None if r is None else [None if s is None else [float(p[a]) for p in s] for s in r] for r in rows], pa.list_(pa.list_(pa.float64())))
    return part(0), part(1)


def test_as_swept_alone():
    rng, rows, boxes = random.Random(5), [], []
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    for i in range(600):
        some = [box(rng.randrange(9), rng.randrange(9), rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(5))]
        some = [r + r[:1] if rng.random() < 0.3 else r for r in some]
        if i % 3:
            some = [[(rng.randrange(10), rng.randrange(10)) for _ in range(rng.randrange(16))] for _ in range(1 if i % 3 == 1 else 3)]
        rows.append(some)
        boxes.append((0, 0, 12, 12) if i % 2 else (x := rng.randrange(4), y := rng.randrange(4), x + rng.randrange(8), y + rng.randrange(8)))
    rows += [None, [], [None], [[(0, 0), (5, 5), (9, 9)]], [[(0, 0), (4, 4), (4, 0), (0, 4)]]]
    boxes += [(0, 0, 12, 12)] * 5
    want = [polygon_area.union_area([np.array(s, dtype=float).reshape(-1, 2) for s in r or [] if s is not None], *b) for r, b in zip(rows, boxes)]
    got = polygon_area.many_areas(*columns(rows), np.array(boxes, dtype=float))
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
    assert got[-2] == 0 and got[-1] == 8 and sum(x > 0 for x in want) > 300
    assert len(polygon_area.many_areas(*columns([]), np.zeros((0, 4)))) == 0


def test_small_shapes_are_never_swept_alone(monkeypatch):
    monkeypatch.setattr(polygon_area, "union_area", lambda *a: 1 / 0)
    tie, square = [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (3, 0), (3, 3), (0, 3)]
    rows = [[tie], [square] * 256, [square, [(0, 0), (1, 1)]]]
    assert polygon_area.many_areas(*columns(rows), np.tile([0.0, 0.0, 4.0, 4.0], (3, 1))).tolist() == [8, 9, 9]
