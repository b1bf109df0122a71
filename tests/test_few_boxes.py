"""Boxes of groups that aren't crowded: settled at once, without grid joins or cells, and against plain loops."""

from __future__ import annotations

import random

import numpy as np

from tessella.operators import spatial

SCHEMA = "g string, id string, x0 int, y0 int, x1 int, y1 int"


def planted() -> list[tuple]:
    rng, rows = random.Random(8), []
    for g, n in [("one", 1), (None, 70), ("full", spatial.DENSE)] + [(f"g{i}", rng.randrange(2, 40)) for i in range(30)]:
        for i in range(n):
            x, y, w = rng.randrange(60), rng.randrange(60), rng.choice([0, 2, 5, 9, 20, 50])
            rows.append((g, f"{i}", x, y, x + w, y + max(0, w + rng.randrange(-2, 3))))
    return rows + [("flat", "a", 3, 3, 3, 9), ("flat", "b", None, 3, 4, 9), ("turned", "a", 9, 9, 3, 3)]


def fails(*_):
    raise AssertionError("a way for crowded groups")


def test_suppressed(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_suppressed", fails)
    rows = planted()
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for larger, most in ((2.0, 0.7), (1.0, 0.7), (2.0, 0.3)):
        want = []
        for g in {r[0] for r in rows}:
            mine, kept = [r for r in rows if r[0] == g], []
            solid = [r for r in mine if r[2] is not None and r[4] > r[2] and r[5] > r[3]]
            want += [(g, r[1]) for r in mine if r not in solid]
            for _, i, *b in sorted(solid, key=lambda r: (-area(r[2:]), r[1])):
                shared = [max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) for k in kept]
                if not any(area(k) >= larger * area(b) and s / area(b) >= most for k, s in zip(kept, shared)):
                    kept.append(b)
                    want.append((g, i))
        got = spatial.suppress_boxes(spark.createDataFrame(rows, SCHEMA), "g", most, larger)
        assert got.columns == ["g", "id"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_united(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_united", fails)
    rows = planted()
    got = {r.g: r for r in spatial.box_overlap(spark.createDataFrame(rows, SCHEMA), "g").collect()}
    assert len(got) == len({r[0] for r in rows})
    for g, r in got.items():
        grid, total = np.zeros((120, 120), dtype=bool), 0
        for h, _, x0, y0, x1, y1 in rows:
            if h == g and x0 is not None:
                grid[min(y0, y1) : max(y0, y1), min(x0, x1) : max(x0, x1)] = True
                total += (x1 - x0) * (y1 - y0)
        assert r.total == total and abs(r.united - grid.sum()) < 1e-6
        assert r.overlap_fraction is None if not total else abs(r.overlap_fraction - (1 - grid.sum() / total)) < 1e-9
