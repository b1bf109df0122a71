"""Exact area of the union of outlines inside a box, as an Arrow-batched function over arrays of rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All edges as (x1, y1, x2, y2), and the ring of each."""
    edges, owner = [], []
    for k, r in enumerate(rings):
        if len(r) >= 3:
            edges.append(np.hstack((r, np.roll(r, -1, axis=0))))
            owner.append(np.full(len(r), k))
    return (np.vstack(edges), np.concatenate(owner)) if edges else (np.zeros((0, 4)), np.zeros(0, dtype=int))


#: Numbers of a matrix that is worked on at once.
CELLS = 1_000_000


def _crossings(e: np.ndarray) -> np.ndarray:
    """The heights at which two edges meet; a level edge's own height is known without.

    Edges are swept from left to right in blocks, each compared with those that
    begin before it ends and reach its heights.
    """
    e = e[e[:, 1] != e[:, 3]]
    left, right = e[:, [0, 2]].min(axis=1), e[:, [0, 2]].max(axis=1)
    by = np.argsort(left, kind="stable")
    e, left, right = e[by], left[by], right[by]
    low, high = e[:, [1, 3]].min(axis=1), e[:, [1, 3]].max(axis=1)
    found, k = [], 0
    while k < len(e):
        z = min(len(e), k + max(1, min(64, CELLS // len(e))))
        last = np.searchsorted(left, right[k:z].max(), side="right")
        near = np.arange(k, last)
        near = near[(low[k:last] <= high[k:z].max()) & (high[k:last] >= low[k:z].min())]
        found.append(_meet(e[k:z], e[near]))
        k = z
    return np.concatenate(found) if found else np.zeros(0)


def _meet(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    d, g = e[:, 2:] - e[:, :2], f[:, 2:] - f[:, :2]
    cross = d[:, None, 0] * g[None, :, 1] - d[:, None, 1] * g[None, :, 0]
    gap = f[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * g[None, :, 1] - gap[..., 1] * g[None, :, 0]) / cross
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / cross
    meet = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return (e[:, None, 1] + np.where(meet, t, 0) * d[:, None, 1])[meet]


def edges_area(e: np.ndarray, owner: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area inside the box of points that lie inside any ring, by the even-odd rule; edges (x1, y1, x2, y2), and each one's ring.

    Between two neighbouring heights of vertices, meeting edges and box sides no
    edges cross, so the covered width is linear there and its middle value
    times the height is exact.  Slabs are taken some at a time, each time with
    the edges that reach them.
    """
    if not len(e) or x1 <= x0 or y1 <= y0:
        return 0.0
    d = e[:, 2:] - e[:, :2]
    heights = [np.array([y0, y1]), e[:, 1], e[:, 3], _crossings(e)]
    for side in (x0, x1):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (side - e[:, 0]) / d[:, 0]
        heights.append((e[:, 1] + t * d[:, 1])[(t >= 0) & (t <= 1) & (d[:, 0] != 0)])
    ys = np.unique(np.concatenate(heights))
    ys = ys[(ys >= y0) & (ys <= y1)]
    low, high = e[:, [1, 3]].min(axis=1), e[:, [1, 3]].max(axis=1)
    total, size = 0.0, max(1, CELLS // len(e))
    for k in range(0, len(ys) - 1, size):
        part = ys[k : k + size + 1]
        here = (low < part[-1]) & (high > part[0])
        if here.any():
            total += _slabs(e[here], owner[here], part, x0, x1)
    return total


def _slabs(e: np.ndarray, owner: np.ndarray, ys: np.ndarray, x0: float, x1: float) -> float:
    """A row for each slab, a column for each edge."""
    d = e[:, 2:] - e[:, :2]
    mid = ((ys[:-1] + ys[1:]) / 2)[:, None]
    spans = (e[:, 1] > mid) != (e[:, 3] > mid)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(spans, e[:, 0] + (mid - e[:, 1]) / d[:, 1] * d[:, 0], x1)
    by = np.lexsort((x, np.where(spans, owner, owner.max() + 1)))  # a ring is crossed an even number of times
    x = np.clip(np.take_along_axis(x, by, axis=1), x0, x1)
    if x.shape[1] % 2:
        x = np.hstack((x, np.full((len(x), 1), x1)))
    begin, end = x[:, 0::2], x[:, 1::2]
    by = np.argsort(begin, axis=1, kind="stable")
    begin, end = np.take_along_axis(begin, by, axis=1), np.take_along_axis(end, by, axis=1)
    reach = np.hstack((np.full((len(x), 1), x0), np.maximum.accumulate(end, axis=1)[:, :-1]))
    width = np.maximum(0.0, end - np.maximum(begin, reach)).sum(axis=1)
    return float(width @ np.diff(ys))


def union_area(rings: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> float:
    """As ``edges_area``, from rings."""
    return edges_area(*_edges(rings), x0, y0, x1, y1)


def boxes_area(boxes: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Of many tiles with equally many boxes each, (tiles, boxes, 4): the area of their boxes' union inside the tile, (tiles, 4)."""
    low, high = np.maximum(boxes[..., :2], within[:, None, :2]), np.minimum(boxes[..., 2:], within[:, None, 2:])
    high = np.maximum(low, high)
    by = np.argsort(low[..., 0], axis=1, kind="stable")[..., None]
    low, high = np.take_along_axis(low, by, axis=1), np.take_along_axis(high, by, axis=1)
    ys = np.sort(np.concatenate((low[..., 1], high[..., 1]), axis=1), axis=1)
    n, k = low.shape[:2]
    out = np.zeros(n)
    tiles, slabs = max(1, CELLS // (2 * k * k)), max(1, CELLS // k)
    for t in range(0, n, tiles):
        a, z, y = low[t : t + tiles, None], high[t : t + tiles, None], ys[t : t + tiles]
        for s in range(0, 2 * k - 1, slabs):
            here = y[:, s : s + slabs + 1]
            inside = (a[..., 1] <= here[:, :-1, None]) & (z[..., 1] >= here[:, 1:, None])
            reach = np.maximum.accumulate(np.where(inside, z[..., 0], -np.inf), axis=2)
            before = np.concatenate((np.full((*reach.shape[:2], 1), -np.inf), reach[..., :-1]), axis=2)
            gain = np.where(inside, np.maximum(0.0, z[..., 0] - np.maximum(a[..., 0], before)), 0.0).sum(axis=2)
            out[t : t + tiles] += (gain * np.diff(here, axis=1)).sum(axis=1)
    return out


def _fields(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column of structs of numbers as one matrix and the rows' offsets; null lists are empty."""
    lists = pc.coalesce(lists, pa.scalar([], lists.type))
    values = lists.flatten()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    return np.stack([values.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(values.type.num_fields)], axis=1) if len(values) else np.zeros((0, values.type.num_fields)), offsets


def listed(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Some fields of lists of structs, (entries, fields), and where each list begins and the last one ends."""
    flat = lists.flatten()
    fields = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
    return fields, np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))


def batch_areas(batch: pa.RecordBatch) -> np.ndarray:
    """Covered area of each row: a box x0, y0, x1, y1 with ``boxes`` and ``edges`` (of rings ``o``) that may reach into it."""
    within = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")], axis=1)
    boxes, b = _fields(batch.column("boxes"))
    edges, e = _fields(batch.column("edges"))
    out, n_boxes, n_edges = np.zeros(len(within)), np.diff(b), np.diff(e)
    plain = n_edges == 0
    for k in np.unique(n_boxes[plain & (n_boxes > 0)]):
        rows = np.flatnonzero(plain & (n_boxes == k))
        out[rows] = boxes_area(boxes[b[rows][:, None] + np.arange(k)], within[rows])
    for i in np.flatnonzero(~plain):
        mine, sides = edges[e[i] : e[i + 1]], boxes[b[i] : b[i + 1]]
        upright = np.concatenate((sides[:, [0, 1, 0, 3]], sides[:, [2, 3, 2, 1]]))  # a box's two upright edges
        first = mine[:, 4].max() + 1
        owner = np.concatenate((mine[:, 4], np.tile(first + np.arange(len(sides)), 2)))
        out[i] = edges_area(np.concatenate((mine[:, :4], upright)), owner, *within[i])
    return out


#: Points of a lone ring at most that is measured together with others of as many.
SMALL = 12


def rings_area(points: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Of many boxes with one ring of equally many points each, (boxes, points, 2): the area inside it by the even-odd rule, inside the box.

    The slabs are those of ``edges_area``, some of them without height.
    """
    n, k = points.shape[:2]
    out, size = np.zeros(n), max(1, CELLS // (k * (k + 2) * (k + 2)))
    for t in range(0, n, size):
        p, box = points[t : t + size], within[t : t + size, :, None]
        q = np.roll(p, -1, axis=1)
        d, gap = q - p, p[:, None] - p[:, :, None]
        level = d[..., 1] == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = d[:, :, None, 0] * d[:, None, :, 1] - d[:, :, None, 1] * d[:, None, :, 0]
            a = (gap[..., 0] * d[:, None, :, 1] - gap[..., 1] * d[:, None, :, 0]) / cross
            b = (gap[..., 0] * d[:, :, None, 1] - gap[..., 1] * d[:, :, None, 0]) / cross
            meet = (cross != 0) & (a >= 0) & (a <= 1) & (b >= 0) & (b <= 1) & ~level[:, :, None] & ~level[:, None, :]
            met = np.where(meet, p[:, :, None, 1] + a * d[:, :, None, 1], box[:, 1:2]).reshape(len(p), -1)
            s = (box[:, 0::2] - p[:, None, :, 0]) / d[:, None, :, 0]
            sides = np.where((s >= 0) & (s <= 1) & (d[:, None, :, 0] != 0), p[:, None, :, 1] + s * d[:, None, :, 1], box[:, 1:2]).reshape(len(p), -1)
            ys = np.sort(np.clip(np.concatenate((box[:, 1], box[:, 3], p[..., 1], met, sides), axis=1), box[:, 1], box[:, 3]), axis=1)
            mid = ((ys[:, :-1] + ys[:, 1:]) / 2)[..., None]
            spans = (p[:, None, :, 1] > mid) != (q[:, None, :, 1] > mid)
            x = np.where(spans, p[:, None, :, 0] + (mid - p[:, None, :, 1]) / d[:, None, :, 1] * d[:, None, :, 0], np.inf)
        x = np.clip(np.sort(x, axis=2), box[:, 0:1], box[:, 2:3])  # a ring is crossed an even number of times
        width = (x[..., 1::2] - x[..., 0 : k // 2 * 2 : 2]).sum(axis=2)
        out[t : t + size] = np.where((box[:, 2, 0] > box[:, 0, 0]) & (box[:, 3, 0] > box[:, 1, 0]), (width * np.diff(ys, axis=1)).sum(axis=1), 0.0)
    return out


def _nested(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists of lists of numbers: the numbers, the inner lists' offsets, and the rows' offsets among these; null lists are empty."""
    lists = pc.coalesce(lists, pa.scalar([], lists.type))
    inner = lists.flatten()
    inner = pc.coalesce(inner, pa.scalar([], inner.type))
    offsets = lambda a: np.concatenate(([0], np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False)))).astype(int)
    return inner.flatten().to_numpy(zero_copy_only=False).astype(float), offsets(inner), offsets(lists)


def many_areas(xs: pa.Array, ys: pa.Array, within: np.ndarray) -> np.ndarray:
    """For each row the area of its box x0, y0, x1, y1 that its rings cover.

    Rows whose rings are all upright rectangles, and those with one small ring,
    are measured many at a time; any other is swept by itself.
    """
    x, ends, rows = _nested(xs)
    points = np.stack((x, _nested(ys)[0]), axis=1)
    sizes, owner = np.diff(ends), np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    usable = np.flatnonzero(sizes >= 3)
    # a rectangle's two turns, as in ``spatial``: each side is level or upright
    corner = np.minimum(ends[usable][:, None] + np.arange(5), max(0, len(points) - 1))
    p = points[corner] if len(usable) else np.zeros((0, 5, 2))
    turns = lambda a, c: (p[:, 0, a] == p[:, 1, a]) & (p[:, 1, c] == p[:, 2, c]) & (p[:, 2, a] == p[:, 3, a]) & (p[:, 3, c] == p[:, 0, c])
    closed = (sizes[usable] == 4) | (sizes[usable] == 5) & (p[:, 4] == p[:, 0]).all(axis=1)
    upright = closed & (turns(0, 1) | turns(1, 0))
    boxes = np.concatenate((p[:, :4].min(axis=1), p[:, :4].max(axis=1)), axis=1)
    n = np.bincount(owner[usable], minlength=len(within))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    known = ~np.isnan(within).any(axis=1)
    plain = known & (n > 0) & (np.bincount(owner[usable], weights=~upright, minlength=len(within)) == 0)
    out = np.zeros(len(within))
    for k in np.unique(n[plain]):
        at = np.flatnonzero(plain & (n == k))
        out[at] = boxes_area(boxes[first[at][:, None] + np.arange(k)], within[at])
    alone = np.zeros(len(within), dtype=int)
    lone = np.flatnonzero(known & ~plain & (n == 1))
    alone[lone] = sizes[usable[first[lone]]]
    for k in np.unique(alone[(alone > 0) & (alone <= SMALL)]):
        at = np.flatnonzero(alone == k)
        out[at] = rings_area(points[ends[usable[first[at]]][:, None] + np.arange(k)], within[at])
    for i in np.flatnonzero(~plain & (n > 0) & ((alone == 0) | (alone > SMALL))):
        mine = usable[first[i] : first[i] + n[i]]
        out[i] = union_area([points[ends[j] : ends[j + 1]] for j in mine], *within[i])
    return out


@F.arrow_udf(T.DoubleType())
def _covered(xs: pa.Array, ys: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    within = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (x0, y0, x1, y1)], axis=1)
    return pa.array(many_areas(xs, ys, within))


def covered_area(rings: str, x0, y0, x1, y1) -> Column:
    """Column form: rings is an array of arrays of points; null counts as none.  Numbers travel as plain arrays."""
    part = lambda c: F.transform(rings, lambda r: F.transform(r, lambda p: p[c]))
    return _covered(part("x"), part("y"), x0, y0, x1, y1)


def clipped(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a box, side by side."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(ring):
            break
        nxt = np.roll(ring, -1, axis=0)
        a, b = keep * (ring[:, axis] - bound), keep * (nxt[:, axis] - bound)
        out = []
        for p, q, m, n in zip(ring, nxt, a, b):
            if m >= 0:
                out.append(p)
            if (m >= 0) != (n >= 0):
                out.append(p + (q - p) * (m / (m - n)))
        ring = np.array(out).reshape(-1, 2)
    return ring


@F.pandas_udf(T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))]))
def _clip(xs: pd.Series, ys: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, a, b, c, d in zip(xs, ys, x0, y0, x1, y1):
        if len(x) and (x.min() < a or x.max() > c or y.min() < b or y.max() > d):
            x, y = clipped(np.stack((x, y), axis=1), a, b, c, d).T
        out.append((x, y))
    return pd.DataFrame(out, columns=["x", "y"])


def clip_ring(ring: str, x0: str, y0: str, x1: str, y1: str) -> Column:
    """Column form of ``clipped``; a ring inside the box stays as it is."""
    part = lambda c: F.coalesce(F.transform(ring, lambda p: p[c]), F.array().cast("array<double>"))
    cut = _clip(part("x"), part("y"), x0, y0, x1, y1)
    return F.arrays_zip(cut["x"].alias("x"), cut["y"].alias("y"))

