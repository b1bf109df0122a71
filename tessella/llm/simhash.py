"""SimHash near-duplicates, linked exactly by vantage-point trees.

Two fingerprints of 64 bits that differ in at most d bits differ in at most
d // 2 bits in one of their 32-bit halves.  So each half has a vantage-point
tree: a node holds a point and a distance, and fingerprints go left or right by
the Hamming distance of their half to that point.  A tree grown from a bounded
sample deals the distinct fingerprints to shards; by the triangle bounds, one
whose ball of radius d // 2 reaches over a boundary also visits the shards
behind it.  Within a shard the same recursion goes on down to small cells,
where pairs are compared bit by bit.  The sample shapes the shards, never the
result.

Equal fingerprints are one point; a shard gives the pairs that join two of its
local groups, not all pairs, and a distributed component search joins them.

Null and empty texts have the fingerprint zero.  A very long text has one
fingerprint of all its shingles.  Null ids are never the least of a group unless
all are null.  Repeated rows share a fingerprint.  An empty table gives no rows;
extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary, column, fresh, id_and_text, kept, numbered, slices, written
from tessella.llm.components import connected_components

#: Fingerprints of the sample that shapes a tree; points of a shard, about; of a cell.
SAMPLE, SHARD, CELL = 20_000, 3_000, 200
#: Rows compared at once with all points of a cell.
BLOCK = 256

PRINTS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("fp", pa.int64())])
PLACED = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("home", pa.bool_()), ("fp", pa.int64())])

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = 256 * np.arange(8)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text's word shingles, as a signed integer."""
    found = text.lower().split()  # A-Z alone; the six ASCII separators
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        hashed = xxhash.xxh64_intdigest
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(begins.tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)
    counts = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, words: int = 3) -> DataFrame:
    """Columns row, id, text to row, id, fp."""

    def run(batches):
        kept("simhash")
        for part in slices(batches):
            fps = pa.array([fingerprint(t, words) for t in binary(part, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([column(part, "row"), column(part, "id"), fps], schema=PRINTS)

    return rows.mapInArrow(run, "row long, id long, fp long")


def half(fps: np.ndarray, which: int) -> np.ndarray:
    return ((fps >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def vantage(points: np.ndarray) -> tuple[np.uint32, int] | None:
    """A vantage point and a distance that split the points, or None if nothing does.

    Of a few candidates the one whose boundary has the fewest points near it.
    """
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(8, len(points))).astype(int)]:
        d = np.bitwise_count(points ^ v)
        at = int(np.median(d))
        for t in {max(0, at - 1), at}:
            left = int((d <= t).sum())
            if 0 < left < len(points):
                cost = int((np.abs(d.astype(np.int16) - t) <= 1).sum()) + abs(2 * left - len(points)) // 2
                if best is None or cost < best[0]:
                    best = (cost, v, t)
    return best and best[1:]


def grow(points: np.ndarray, most: int) -> list | int:
    """A tree over a sample of halves: [vantage, distance, left, right], or a leaf.  Leaves are numbered by ``number``."""
    if len(points) <= most or (found := vantage(points)) is None:
        return -1
    d = np.bitwise_count(points ^ found[0])
    return [int(found[0]), found[1], grow(points[d <= found[1]], most), grow(points[d > found[1]], most)]


def number(tree: list | int, start: int = 0) -> tuple[list | int, int]:
    if tree == -1:
        return start, start + 1
    left, start = number(tree[2], start)
    right, start = number(tree[3], start)
    return [tree[0], tree[1], left, right], start


def place(tree: list | int, at: np.ndarray, points: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    """Append (leaf, indices, home) for every leaf that a ball reaches; balls go on from their home to later leaves only."""
    if not len(at):
        return
    if not isinstance(tree, list):
        out.append((tree, at, home))
        return
    v, t, left, right = tree
    d = np.bitwise_count(points[at] ^ np.uint32(v)).astype(np.int16)
    inside = d <= t
    go = np.where(home, inside, d - radius <= t)
    place(left, at[go], points, home[go], radius, out)
    go = d + radius > t
    place(right, at[go], points, (home & ~inside)[go], radius, out)


class Groups:
    """Disjoint sets of the points 0..n-1; ``of`` holds each point's least member as far as it is known."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = int(of[i])
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.of[max(a, b)] = min(a, b)
        return a != b

def link_cell(fps: np.ndarray, home: np.ndarray, visit: np.ndarray, most: int, groups: Groups, links: list) -> None:
    """Compare home points with each other and with visitors, in blocks.

    ``links`` gets pairs of at most ``most`` differing bits, those that join two groups.
    """
    every = np.concatenate((home, visit))
    values = fps[every]
    for k in range(0, len(home), BLOCK):
        rows = home[k : k + BLOCK]
        near = np.bitwise_count(fps[rows][:, None] ^ values[None, k:]) <= most
        near[np.arange(len(rows)), np.arange(len(rows))] = False
        for i in np.flatnonzero(near.any(axis=1)):
            found = every[k:][near[i]]
            for j in found[np.unique(groups.of[found], return_index=True)[1]].tolist():
                if groups.join(int(rows[i]), j):
                    links.append((rows[i], j))


def link(fps: np.ndarray, halves: np.ndarray, home: np.ndarray, visit: np.ndarray, most: int, groups: Groups, links: list) -> None:
    """The recursion of a shard: split while that leaves less to compare, then compare."""
    if len(home) > CELL and (found := vantage(halves[home])) is not None:
        v, t = found
        radius = most // 2
        dh, dv = np.bitwise_count(halves[home] ^ v).astype(np.int16), np.bitwise_count(halves[visit] ^ v).astype(np.int16)
        left, right = home[dh <= t], home[dh > t]
        to_left = visit[dv - radius <= t]
        to_right = np.concatenate((visit[dv + radius > t], home[(dh <= t) & (dh + radius > t)]))
        if len(left) * (len(left) + len(to_left)) + len(right) * (len(right) + len(to_right)) < 0.95 * len(home) * (len(home) + len(visit)):
            link(fps, halves, left, to_left, most, groups, links)
            link(fps, halves, right, to_right, most, groups, links)
            return
    link_cell(fps, home, visit, most, groups, links)


def _shard_links(most: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        home = table["home"].to_numpy()
        links: list = []
        link(fps, half(fps, table["tree"][0].as_py()), np.flatnonzero(home), np.flatnonzero(~home), most, Groups(len(fps)), links)
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        signed = fps.view(np.int64)
        return pa.table({"a": pa.array(signed[a]), "b": pa.array(signed[b])})

    return run


def linked(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Columns a, b: pairs of at most ``most`` differing bits that connect exactly what all such pairs connect.

    ``distinct`` has one column fp without repetition and should be a written table.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("fp").limit(2 * SAMPLE).toArrow()["fp"].to_numpy()
    sample = np.sort(sample).view(np.uint64)
    trees = [number(grow(half(sample, k), max(2, int(SHARD * share))))[0] for k in (0, 1)]
    sent = spark.sparkContext.broadcast(trees)  # of the sample's size at most

    def deal(batches):
        for batch in batches:
            fps = column(batch, "fp").to_numpy(zero_copy_only=False)
            for k, tree in enumerate(sent.value):
                out: list = []
                place(tree, np.arange(len(fps)), half(fps.view(np.uint64), k), np.ones(len(fps), dtype=bool), most // 2, out)
                for leaf, at, home in out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, dtype=np.int32)) for x in (k, leaf)] + [pa.array(home), pa.array(fps[at])], schema=PLACED)

    placed = distinct.select("fp").mapInArrow(deal, "tree int, leaf int, home boolean, fp long")
    return placed.groupBy("tree", "leaf").applyInArrow(_shard_links(most), "a long, b long")


def near_groups(rows: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """Columns row, id, text to row, id, fp, component_id (the least id of the group)."""
    prints = written(fingerprints(rows, words), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(linked(distinct, most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp").select("row", "id", "fp", "component_id", "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return near_groups(rows, words, most).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group: that with the least id, of equal ids the first one written."""
    row = fresh(docs, "__row")
    all_rows = numbered(docs, row)
    rows = all_rows.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    groups = near_groups(rows, words, most)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    stays = groups.groupBy("root").agg(F.min_by("row", order).alias(row)).select(row)
    return all_rows.join(stays, row, "left_semi").select(*docs.columns)
