"""Ranks by bands, and batches of forced ratio against a plain version that deals row by row."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import ranking, sampling


def order(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16), key


def plain_stream(keys, quota, batches, seed, taken):
    """Deal cycles; what repeats or is taken leaves a gap; gaps are offered rows in turn."""
    places = []
    cycle = 0
    while len(places) < quota * batches:
        places += sorted(keys, key=lambda k: (order(seed, f"{cycle}:{k}")[0], k))
        cycle += 1
    places = places[: quota * batches]
    out, gaps = [set() for _ in range(batches)], []
    for at, k in enumerate(places):
        b = at // quota
        if k in out[b] or k in taken[b]:
            gaps.append((at, b))
        else:
            out[b].add(k)
    spare, turn = sorted(keys, key=lambda k: order(seed + 1, k)), 0
    waiting = dict(gaps)
    while waiting:
        claims: dict = {}
        for g, b in waiting.items():
            for o in range(min(16, len(keys))):
                k = spare[(g * 16 + turn * 16 + o) % len(keys)]
                if k not in out[b] and k not in taken[b]:
                    claims[b, k] = min(claims.get((b, k), (g, o)), (g, o))
        won: dict = {}
        for (b, k), (g, o) in claims.items():
            won[g] = min(won.get(g, (o, k, b)), (o, k, b))
        for g, (_, k, b) in won.items():
            out[b].add(k)
            del waiting[g]
        turn += 1
    return out


def plain_batches(pos, neg, hard, size, fraction, share, batches, seed):
    n_pos = round(size * fraction)
    n_hard = round((size - n_pos) * share) if hard else 0
    none = [set() for _ in range(batches)]
    taken = plain_stream(hard, n_hard, batches, seed + 2, none) if n_hard else none
    parts = {"positive": plain_stream(pos, n_pos, batches, seed, none), "hard": taken}
    if size - n_pos - n_hard:
        parts["uniform"] = plain_stream(neg, size - n_pos - n_hard, batches, seed + 4, taken)
    return {(b, k, s) for s, found in parts.items() for b, keys in enumerate(found) for k in keys}


@pytest.mark.parametrize("n_pos, n_neg, n_hard, size, fraction, share, batches", [(9, 60, 12, 16, 0.25, 0.5, 11), (4, 13, 0, 16, 0.25, 0.0, 7), (50, 40, 6, 10, 0.5, 1.0, 9), (5, 12, 12, 16, 0.25, 0.25, 20)])
def test_batches_equal_plain_dealing(spark, n_pos, n_neg, n_hard, size, fraction, share, batches):
    rows = [(k, 1) for k in range(n_pos)] + [(1000 + k, 0) for k in range(n_neg)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id long, y int, source string").repartition(4)
    hard = spark.createDataFrame([(1000 + k,) for k in range(n_hard)], "id long")
    got = sampling.ratio_batches(df, size, fraction, batches, 5, "id", hard=hard, share=share).collect()
    want = plain_batches(list(range(n_pos)), [1000 + k for k in range(n_neg)], [1000 + k for k in range(n_hard)], size, fraction, share, batches, 5)
    assert len(got) == len(want) == size * batches
    assert {(r.batch, r.id, r.source) for r in got} == want and all(r.y == (r.source == "positive") for r in got)


def test_composition_and_epoch_length(spark):
    df = spark.createDataFrame([(k, int(k < 30), k / 200) for k in range(230)], "id long, y int, s double")
    hard = sampling.hard_pool(df.filter("y = 0"), "s", "id", 0.2)
    assert {r.id for r in hard.collect()} == set(range(190, 230))
    log = sampling.composition(sampling.ratio_batches(df, 16, 0.25, None, 1, "id", hard=hard, share=0.25), ["batch"]).collect()
    assert len(log) == 200 // 9 and {tuple(r)[1:] for r in log} == {(16, 4, 12, 3)}
    assert len(sampling.composition(sampling.ratio_batches(df, 16, 0.25, None, 1, "id"), ["batch"]).collect()) == 200 // 12
    assert sampling.epoch_length(200, 40, 12, 0) == 3 and sampling.epoch_length(5, 0, 0, 12) == 1


def test_what_no_batch_can_be_made_of_is_an_error(spark):
    df = spark.createDataFrame([(k, int(k < 3)) for k in range(20)], "id long, y int")
    hard = df.filter("id > 17").select("id")
    for bad in (dict(batch_size=0), dict(fraction=0.0), dict(fraction=0.01), dict(fraction=1.0), dict(batch_size=16), dict(batches=0), dict(hard=hard, share=1.5), dict(hard=hard, share=1.0), dict(hard=df.filter("id < 5").select("id"), share=0.7)):
        given = dict(batch_size=8, fraction=0.25, batches=2) | bad
        with pytest.raises(ValueError):
            sampling.ratio_batches(df, given.pop("batch_size"), given.pop("fraction"), given.pop("batches"), 1, "id", **given)
    with pytest.raises(ValueError):
        sampling.ratio_batches(df.unionByName(df.withColumn("y", 1 - F.col("y"))), 8, 0.25, 2, 1, "id")
    with pytest.raises(ValueError):
        sampling.hard_pool(df, "y", "id", 0.0)
    # repeated rows of one class count once
    again = sampling.ratio_batches(df.unionByName(df), 8, 0.25, 2, 1, "id").collect()
    assert len(again) == 16 == len({(r.batch, r.id) for r in again})


def test_ranks_by_bands(spark):
    """A third of all values are equal; nulls come first; ranks are those of a plain sort."""
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.5, 0.5, rng.random(), float(rng.randrange(5))]), rng.choice(["a", "a", "a", None, "b"])) for k in range(12_000)]
    df = spark.createDataFrame(rows, "id long, v double, g string").repartition(6)
    by = collections.defaultdict(list)
    for k, v, g in rows:
        by[g].append(((v is not None, v or 0), k))
    want = {k: i + 1 for found in by.values() for i, (_, k) in enumerate(sorted(found))}
    out = ranking.ranked(df, [F.col("v"), F.col("id")], ["g"])
    assert {r.id: r["rank"] for r in out.collect()} == want
    every = {k: i + 1 for i, (_, k) in enumerate(sorted(x for found in by.values() for x in found))}
    assert {r.id: r["rank"] for r in ranking.ranked(df, [F.col("v"), F.col("id")]).collect()} == every
    bands = ranking.with_band(df, [F.col("v"), F.col("id")]).groupBy("__band").count().collect()
    assert len(bands) == ranking.BANDS and max(r["count"] for r in bands) < 12_000 / 20
    assert ranking.ranked(df.limit(0), [F.col("id")]).count() == 0
