"""A bootstrap over whole units, in blocks: how often each unit is drawn is one packed vector over all replicates.

Rows meet their unit's vector and are summed up by probability in their batch, so
no row is repeated for each replicate.  Probabilities are cut into bands.  A
band's rows are walked from the highest probability down for all replicates at
once, on top of what the bands above hold, which is summed up exactly before.
They come sorted, so a task holds ROWS of them at a time, however full a band is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import exchanged
from tessella.operators.ranking import BANDS, ranked, with_band
from tessella.session import can_checkpoint

#: Units whose draws are counted together; draws that a task makes at a time, about.
UNITS, DRAWS = 1024, 500_000
#: Rows of a band, about, while bands are fewer than BANDS; rows that a task unpacks at a time; replicates whose sums over bands are run up at a time.
BAND_ROWS, ROWS, CHUNK = 4096, 500, 125

KINDS = "band int, prob double, kind int, weights binary"


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each as wide as the largest needs, compressed."""
    a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
    return bytes([a.itemsize]) + pa.compress(a.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * data[0], "zstd", asbytes=True), dtype=f"<u{data[0]}")


def draw_vectors(units: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """``units`` (k: their numbers from 0) with ``times``: how often each is drawn in each replicate, packed.

    A draw's index is the first 32 bits of an md5, so it can be repeated anywhere.
    """
    step = max(1, DRAWS // replicates)
    code = np.dtype("<u4") if UNITS * replicates < 1 << 32 else np.dtype("<u8")

    def drawn(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                slots = [b"%d" % s for s in range(first * step, min(n, (first + 1) * step))]
                digests = b"".join([hashlib.md5(b"%d:%d:%b" % (seed, rep, s)).digest() for rep in range(replicates) for s in slots])
                k = np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % n
                codes = k % UNITS * replicates + np.repeat(np.arange(replicates), len(slots))
                by = np.argsort(k // UNITS, kind="stable")
                blocks, starts = np.unique((k // UNITS)[by], return_index=True)
                parts = [p.astype(code).tobytes() for p in np.split(codes[by], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(parts, pa.binary())], names=["block", "codes"])

    def counted(key, table):
        times = np.zeros(UNITS * replicates, dtype=np.int64)
        for part in table.column("codes").to_pylist():
            times += np.bincount(np.frombuffer(part, dtype=code), minlength=len(times))
        times = times.reshape(UNITS, replicates)
        some = np.flatnonzero(times.any(axis=1))
        return pa.table({"k": pa.array(key[0].as_py() * UNITS + some), "times": pa.array([packed(times[i]) for i in some], pa.binary())})

    slots = units.sparkSession.range(-(-n // step))
    vectors = slots.mapInArrow(drawn, "block long, codes binary").groupBy("block").applyInArrow(counted, "k long, times binary")
    return units.join(exchanged(vectors), "k").drop("k")


def _summed(replicates: int):
    """Ties with their unit's draws to weights by band, probability and kind; with a null probability a task's sums by band and
    kind, and as band -1 those of hits."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                band, prob, kind, hit, c = (part.column(part.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("band", "prob", "kind", "hit", "c"))
                times = np.stack([unpacked(t, replicates) for t in part.column(part.schema.get_field_index("times")).to_pylist()]).astype(np.int64)
                by = np.lexsort((hit, kind, prob, band))
                band, prob, kind, hit, times = band[by], prob[by], kind[by], hit[by], times[by]
                times *= c[by][:, None]
                new = (np.diff(band) != 0) | (np.diff(prob) != 0) | (np.diff(kind) != 0)
                starts = np.append(0, np.flatnonzero(new) + 1)
                weights = np.add.reduceat(times, starts, axis=0)
                for i, w in zip(starts.tolist(), weights):
                    for key in [(int(band[i]), int(kind[i]))] + [(-1, int(kind[i]))] * bool(hit[i]):
                        sums[key] = sums[key] + w if key in sums else w.copy()
                rows = [pa.array(band[starts], pa.int32()), pa.array(prob[starts]), pa.array(kind[starts], pa.int32()), pa.array([packed(w) for w in weights], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["band", "prob", "kind", "weights"])
        if sums:
            rows = [pa.array([b for b, _ in sums], pa.int32()), pa.nulls(len(sums), pa.float64()), pa.array([k for _, k in sums], pa.int32()), pa.array([packed(w) for w in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["band", "prob", "kind", "weights"])

    return run


def _walked(replicates: int):
    """Bands' rows from the highest probability down to a task's part of each replicate's average precision.

    Before a band come rows without a probability, whose kind is the first
    replicate that they hold sums of.
    """

    def run(batches):
        score, here, at_prob = np.zeros(replicates), None, None
        sums, tie = np.zeros((6, replicates), dtype=np.int64), np.zeros((2, replicates), dtype=np.int64)  # so far; of the last probability, by kind

        def add():
            """The last probability has no more rows."""
            if at_prob is not None:
                sums[:2] += tie
                score[:] += tie[1] / np.maximum(1, sums[4]) * sums[1] / np.maximum(1, sums[0] + sums[1])
                tie[:] = 0

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                band, prob, kind = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                weights = part.column(3).to_pylist()
                head = np.isnan(prob)
                ends = np.flatnonzero((np.diff(band) != 0) | (np.diff(prob) != 0) | head[1:] | head[:-1]) + 1
                for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(band)]):
                    if band[i] != here or head[i] or prob[i] != at_prob:
                        add()
                        here, at_prob = band[i], None
                    if head[i]:
                        s = np.frombuffer(weights[i], dtype=np.int64).reshape(6, -1)
                        sums[:, kind[i] : kind[i] + s.shape[1]] = s
                        continue
                    at_prob = prob[i]
                    for k, w in zip(kind[i:j].tolist(), weights[i:j]):
                        if k < 2:
                            tie[k] += unpacked(w, replicates)
        add()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(score)], names=["rep", "score"])

    return run


def unit_scores(ties: DataFrame, units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """Columns rep, average_precision, n_tp, n_fp, n_fn, n_tn of each replicate.

    ``units`` has each unit once; ``ties`` has ``unit``, prob, kind (1 positive,
    0 negative, 2 negative only in counts), hit (the probability reaches the
    threshold) and c, their rows.
    """
    can_checkpoint(ties.sparkSession)
    n, rows = units.count(), ties.count()
    bands = max(1, min(BANDS, rows // BAND_ROWS))
    vectors = draw_vectors(ranked(units, [F.col(unit)], name="k").withColumn("k", F.col("k") - 1), max(1, n), replicates, seed)
    placed = with_band(ties, [F.col("prob")], bands, "band").select(unit, "band", "prob", "kind", "hit", "c")
    weighted = placed.join(exchanged(vectors), unit).select("band", "prob", "kind", "hit", "c", "times").mapInArrow(_summed(replicates), KINDS).checkpoint()
    chunks = [(a, min(replicates, a + CHUNK)) for a in range(0, replicates, CHUNK)]

    def added(key, table):
        sums = np.zeros((3, replicates), dtype=np.int64)
        for kind, w in zip(table.column("kind").to_pylist(), table.column("weights").to_pylist()):
            sums[kind] += unpacked(w, replicates).astype(np.int64)
        band = [key[0].as_py()] * len(chunks)
        return pa.table({"first": pa.array([a for a, _ in chunks], pa.int32()), "band": pa.array(band, pa.int32()), "sums": pa.array([sums[:, a:b].tobytes() for a, b in chunks], pa.binary())})

    def above(key, table):
        """For each band the weights in the bands above and in all; as band -1 hits and all."""
        of = {b: np.frombuffer(s, dtype=np.int64).reshape(3, -1) for b, s in zip(table.column("band").to_pylist(), table.column("sums").to_pylist())}
        hits = of.pop(-1, None)
        total = sum(of.values())
        before, out = np.zeros_like(total), {-1: np.zeros_like(total) if hits is None else hits}
        for b in sorted(of, reverse=True):
            out[b], before = before, before + of[b]
        sums = [np.concatenate((x, total)).tobytes() for x in out.values()]
        return pa.table({"first": pa.array([key[0].as_py()] * len(out), pa.int32()), "band": pa.array(list(out), pa.int32()), "sums": pa.array(sums, pa.binary())})

    sums = weighted.filter("prob IS NULL").groupBy("band").applyInArrow(added, "first int, band int, sums binary")
    sums = sums.groupBy("first").applyInArrow(above, "first int, band int, sums binary").checkpoint()  # a row for each band and chunk

    def points(batches):
        for batch in batches:
            for first, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hit, total = np.frombuffer(s, dtype=np.int64).reshape(2, 3, -1)
                miss = total - hit
                found = [np.arange(first, first + hit.shape[1]), hit[1], hit[0] + hit[2], miss[1], miss[0] + miss[2]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["rep", "n_tp", "n_fp", "n_fn", "n_tn"])

    rows = weighted.filter("prob IS NOT NULL").select("band", "prob", "kind", "weights")
    heads = sums.filter("band >= 0").select("band", F.lit(None).cast("double").alias("prob"), F.col("first").alias("kind"), F.col("sums").alias("weights"))
    walk = rows.unionByName(heads).repartition("band").sortWithinPartitions("band", F.col("prob").desc_nulls_first())
    scores = walk.mapInArrow(_walked(replicates), "rep long, score double").groupBy("rep").agg(F.sum("score").alias("average_precision"))
    counts = sums.filter("band = -1").select("first", "sums").mapInArrow(points, "rep long, n_tp long, n_fp long, n_fn long, n_tn long")
    return counts.join(scores, "rep")
