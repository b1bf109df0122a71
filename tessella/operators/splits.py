"""Splits and folds without leakage between specimens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    """The first 32 bits of md5(seed:key): an order that doesn't depend on how rows come."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")


def quota_split(slides: DataFrame, quotas: dict[str, tuple[int, int]], seed: int, key: str = "stem", stratum: str = "stratum", forced: str | None = None) -> DataFrame:
    """In each stratum the first rows of a seeded order go to val, the next to test, the rest to train.

    quotas: (val, test) by stratum; a stratum without a quota or with too few
    rows is an error.  Rows whose ``forced`` column is true go to train first.
    """
    free = slides if forced is None else slides.filter(~F.col(forced))
    sizes = {r[0]: r[1] for r in free.groupBy(stratum).count().collect()}  # one row for each stratum
    if missing := sorted(set(sizes) - set(quotas)):
        raise ValueError(f"no quota for {missing}")
    if short := sorted(s for s, (v, t) in quotas.items() if v + t > sizes.get(s, 0)):
        raise ValueError(f"too few rows for the quota of {short}")
    table = slides.sparkSession.createDataFrame([(s, v, t) for s, (v, t) in quotas.items()], f"{stratum} string, __v int, __t int")
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key))
    dealt = free.join(F.broadcast(table), stratum).withColumn("__k", k)
    split = F.when(F.col("__k") <= F.col("__v"), "val").when(F.col("__k") <= F.col("__v") + F.col("__t"), "test").otherwise("train")
    out = dealt.select(*slides.columns, split.alias("split"))
    return out if forced is None else out.unionByName(slides.filter(F.col(forced)).withColumn("split", F.lit("train")))


def specimen_counts(index: DataFrame, sizes: list[int]) -> DataFrame:
    """By specimen and site: tiles, positives and ambiguous ones of each size, and the sorted slides."""
    aggs = [F.sort_array(F.collect_set("stem")).alias("slides")]
    for s in sizes:
        at = F.col("tile_size") == s
        aggs += [F.count_if(at).alias(f"tiles_{s}"), F.count_if(at & (F.col("label") == "positive")).alias(f"positives_{s}"), F.count_if(at & (F.col("label") == "ambiguous")).alias(f"ambiguous_{s}")]
    return index.groupBy("specimen", "site").agg(*aggs)


def straddling(df: DataFrame, unit: str = "specimen") -> DataFrame:
    """Units that stand in more than one split, with those splits in order."""
    return df.groupBy(unit).agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def fold_search(counts: DataFrame, n_folds: int, floor: int, ratio: float, sizes: list[int], anchors: list[str] = ()) -> DataFrame:
    """All assignments of specimens to folds, tried out; the one with the least worst spread of positive rates, the first on ties.

    ``counts`` has a row for each specimen.  Anchors stand in folds by their
    sorted position.  A fold under the floor of positives at the first size, or
    folds whose tile numbers differ by more than the ratio, aren't feasible.
    """
    rows = [r.asDict() for r in counts.orderBy("specimen").collect()]  # specimens are few: all n^k assignments are tried
    fixed = {s: i % n_folds for i, s in enumerate(sorted(anchors))}
    free = [r["specimen"] for r in rows if r["specimen"] not in fixed]
    total = n_folds ** len(free)
    if total > 10**8:
        raise ValueError("too many specimens to try all assignments")
    ids = counts.sparkSession.range(total)
    digit = {s: F.pmod(F.floor(F.col("id") / F.lit(n_folds ** (len(free) - 1 - i))), F.lit(n_folds)).cast("int") for i, s in enumerate(free)}
    at = {r["specimen"]: digit.get(r["specimen"], F.lit(fixed.get(r["specimen"], 0))) for r in rows}
    tried = ids.select("id", *[at[r["specimen"]].alias(f"s{k}") for k, r in enumerate(rows)])

    def of(fold: int, column: str) -> Column:
        out = F.lit(0)
        for k, r in enumerate(rows):
            out = out + F.when(F.col(f"s{k}") == fold, F.lit(int(r[column]))).otherwise(0)
        return out

    spreads, ok = [], F.lit(True)
    for j, s in enumerate(sizes):
        tiles, positives = [of(f, f"tiles_{s}") for f in range(n_folds)], [of(f, f"positives_{s}") for f in range(n_folds)]
        rates = [p / F.nullif(t, F.lit(0)) for p, t in zip(positives, tiles)]
        for t, p in zip(tiles, positives):
            ok = ok & (t > 0) & ((p >= floor) if j == 0 else F.lit(True))
        ok = ok & (F.greatest(*tiles) <= ratio * F.least(*tiles))
        spreads.append(F.greatest(*rates) - F.least(*rates))
    worst = F.greatest(*spreads) if len(spreads) > 1 else spreads[0]
    found = tried.filter(ok).select("id", worst.alias("spread"), F.array(*[f"s{k}" for k in range(len(rows))]).alias("folds"))
    best = found.agg(F.min(F.struct("spread", "id", "folds")).alias("b")).filter("b IS NOT NULL")
    names = F.array(*[F.lit(r["specimen"]) for r in rows])
    return best.select(F.col("b.spread").alias("spread"), F.inline(F.transform(F.arrays_zip(names.alias("specimen"), F.col("b.folds").alias("fold")), lambda z: z)))


def assign_folds(counts: DataFrame, anchor_site: str, n_folds: int, floors: dict[int, int], sizes: list[int], cap_size: int | None, ratio: float) -> DataFrame:
    """The fold of each specimen, from 1: specimen, fold, spread.

    One specimen of the anchor site stands in each fold, in order of names; all
    assignments of the others are tried.  Feasible ones have at least the floor
    of positives of each size in every fold, tiles of every size in ``sizes``,
    and at ``cap_size`` (none without one) at most ``ratio`` times the tiles of
    the least fold in the largest.  Of them the one with the least worst spread
    of positive rates over ``sizes`` is taken, the first in order on ties.  No
    feasible one is an error.
    """
    needed = sorted({*sizes, *floors, *([cap_size] if cap_size else [])})
    if lacking := [c for s in needed for c in (f"tiles_{s}", f"positives_{s}") if c not in counts.columns]:
        raise ValueError(f"counts lack {lacking}")
    n = counts.count()
    n_anchors = counts.filter(F.col("site") == anchor_site).count()
    if n_anchors != n_folds:
        raise ValueError(f"{n_folds} folds need as many specimens of {anchor_site}, which has {n_anchors}")
    if n_folds ** (n - n_anchors) > 10**8:
        raise ValueError("too many specimens to try all assignments")
    rows = counts.orderBy("specimen").collect()
    anchors, others = ([r for r in rows if (r.site == anchor_site) == flag] for flag in (True, False))
    ids = counts.sparkSession.range(n_folds ** len(others))
    digits = [F.pmod(F.floor(F.col("id") / F.lit(n_folds ** (len(others) - 1 - i))), F.lit(n_folds)).cast("int").alias(f"s{i}") for i in range(len(others))]
    tried = ids.select("id", *digits)

    def totals(column: str) -> list[Column]:
        out = []
        for fold in range(n_folds):
            total = F.lit(int(anchors[fold][column]))
            for i, r in enumerate(others):
                total = total + F.when(F.col(f"s{i}") == fold, F.lit(int(r[column]))).otherwise(0)
            out.append(total)
        return out

    # sums first, in columns of their own, so that no expression is written out twice
    summed = tried.select("*", *[t.alias(f"{c}_{k}") for s in needed for c in (f"tiles_{s}", f"positives_{s}") for k, t in enumerate(totals(c))])
    of = lambda c: [F.col(f"{c}_{k}") for k in range(n_folds)]
    most = lambda x: F.greatest(*x) if n_folds > 1 else x[0]
    fewest = lambda x: F.least(*x) if n_folds > 1 else x[0]
    ok = F.lit(True)
    for s, floor in floors.items():
        ok = ok & (fewest(of(f"positives_{s}")) >= floor)
    if cap_size:
        ok = ok & (most(of(f"tiles_{cap_size}")) <= ratio * fewest(of(f"tiles_{cap_size}")))
    spreads = []
    for s in sizes:
        ok = ok & (fewest(of(f"tiles_{s}")) > 0)
        rates = [p / F.nullif(t, F.lit(0)) for p, t in zip(of(f"positives_{s}"), of(f"tiles_{s}"))]
        spreads.append(most(rates) - fewest(rates))
    worst = F.greatest(F.lit(0.0), *spreads) if spreads else F.lit(0.0)
    best = summed.filter(ok).agg(F.min(F.struct(worst.alias("spread"), "id", F.array(*[F.lit(0), *[f"s{i}" for i in range(len(others))]]).alias("folds"))).alias("b")).first().b
    if best is None:
        raise ValueError(f"no assignment has the positives {floors} in every fold and tiles within {ratio} of each other")
    found = [(r.specimen, k + 1, best.spread) for k, r in enumerate(anchors)] + [(r.specimen, f + 1, best.spread) for r, f in zip(others, best.folds[1:])]
    return counts.sparkSession.createDataFrame(sorted(found), "specimen string, fold int, spread double")


def inner_val(counts: DataFrame, eligible: Column, positives: str, tiles: str, by: list[str]) -> DataFrame:
    """In each fold the eligible specimen whose rate is nearest to the whole table's, by name on ties."""
    corpus = counts.agg((F.sum(positives) / F.nullif(F.sum(tiles), F.lit(0))).alias("__c"))
    rate = F.col(positives) / F.nullif(F.col(tiles), F.lit(0))
    some = counts.filter(eligible).crossJoin(F.broadcast(corpus))  # one row
    return some.groupBy(*by).agg(F.min_by("specimen", F.struct(F.abs(rate - F.col("__c")), F.col("specimen"))).alias("inner_val_specimen"))


def fold_rollup(counts: DataFrame, size: int) -> DataFrame:
    """Tiles and positives of each fold with the rate to four places, half to even; null without tiles."""
    t, p = F.sum(f"tiles_{size}"), F.sum(f"positives_{size}")
    return counts.groupBy("fold").agg(t.alias("tiles"), p.alias("positives"), F.bround(p / F.nullif(t, F.lit(0)), 4).alias("positive_rate"))


def fold_splits(slides: DataFrame, inner: DataFrame) -> DataFrame:
    """For each held-out fold, every slide's split: test if in the fold, val if its specimen is another fold's inner one, else train.

    ``slides`` has stem, specimen, fold; ``inner`` has fold, inner_val_specimen, one row for each fold.
    """
    folds = slides.select(F.col("fold").alias("held_out")).distinct()  # few
    vals = inner.select(F.col("fold").alias("__f"), F.col("inner_val_specimen").alias("specimen"))
    known = slides.join(F.broadcast(vals), "specimen", "left")
    pairs = known.crossJoin(F.broadcast(folds))
    split = F.when(F.col("fold") == F.col("held_out"), "test").when(F.col("__f").isNotNull() & (F.col("__f") != F.col("held_out")), "val").otherwise("train")
    return pairs.select("held_out", "stem", "specimen", "fold", split.alias("split"))


def isolation_breaks(df: DataFrame, expected: DataFrame, unit: str = "specimen") -> DataFrame:
    """Pairs (unit, split) that stand only in the rows or only in the expectation."""
    a, b = df.select(unit, "split").distinct(), expected.select(unit, "split").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def coverage_breaks(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Keys that weren't given exactly once: columns key, times, expected."""
    times = got.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    both = expected.select(key).distinct().withColumn("__e", F.lit(True)).join(times, key, "full_outer")
    both = both.select(key, F.coalesce("times", F.lit(0).cast("long")).alias("times"), F.coalesce("__e", F.lit(False)).alias("expected"))
    return both.filter(~F.col("expected") | (F.col("times") != 1))
