"""Bootstrap intervals that resample single rows, as a control beside those that resample whole units.

Drawing n rows with replacement is drawing, for each distinct probability, how
many of its positives and negatives come: a multinomial over ties.  Ties are cut
into bands; the bands' shares of every replicate are drawn first, then each band
draws its own ties by a seed of its own, so that it can be drawn again wherever
it runs.  A first pass gives the bands' sums, which are added up from the
highest probability down; a second one draws the same again and adds up each
replicate's average precision.  No row is copied, and no task holds more than a
band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import with_band
from tessella.session import can_checkpoint

#: Replicates that a band draws at a time.
BLOCK = 32


def band_draws(pdf: pd.DataFrame, seed: int, band: int, totals: np.ndarray):
    """For some replicates at a time: their numbers, and how often each tie's positives and negatives were drawn.

    ``pdf`` has a band's ties in order, ``totals`` the rows that each replicate draws in the band.
    """
    cells = np.concatenate((pdf["pos"].to_numpy(), pdf["neg"].to_numpy())).astype(float)
    shares = cells / cells.sum()
    for first in range(0, len(totals), BLOCK):
        some = totals[first : first + BLOCK]
        drawn = np.random.default_rng([seed, band, first]).multinomial(some, shares)
        yield np.arange(first, first + len(some)), drawn[:, : len(pdf)], drawn[:, len(pdf) :]


def band_totals(sizes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How many of a replicate's rows fall into each band: replicates by bands."""
    return np.random.default_rng([seed, 1 << 20]).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=replicates)


def row_interval(df: DataFrame, threshold: float, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Percentile intervals (2.5, 97.5) of average precision, F1 and recall over replicates of single rows: n_usable, metric, low, high.

    Columns y and prob; rows without a probability don't count.  Replicates with
    one class are left out; under two usable ones give nulls.
    """
    if replicates < 1:
        raise ValueError("a bootstrap takes one replicate at least")
    can_checkpoint(df.sparkSession)
    known = df.filter(F.col("prob").isNotNull() & ~F.isnan("prob"))
    ties = known.groupBy("prob").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).filter("pos + neg > 0")
    ties = with_band(ties, [-F.col("prob")]).checkpoint()
    found = {r["__band"]: r.n for r in ties.groupBy("__band").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()}  # BANDS rows
    bands = sorted(found)
    drawn = band_totals(np.array([found[b] for b in bands]), replicates, seed) if bands else np.zeros((replicates, 0), dtype=int)
    totals = {b: drawn[:, k] for k, b in enumerate(bands)}

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("prob", ascending=False), []
        hit = (pdf["prob"] >= threshold).to_numpy()
        for reps, pos, neg in band_draws(pdf, seed, key[0], totals[key[0]]):
            out.append(pd.DataFrame({"rep": reps, "band": key[0], "pos": pos.sum(axis=1), "neg": neg.sum(axis=1), "tp": pos[:, hit].sum(axis=1), "fp": neg[:, hit].sum(axis=1)}))
        return pd.concat(out)

    of = ties.groupBy("__band").applyInPandas(sums, "rep int, band int, pos long, neg long, tp long, fp long")
    above, all_ = Window.partitionBy("rep").orderBy("band").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("rep")  # BANDS rows for each replicate
    zero = F.lit(0).cast("long")
    of = of.select("rep", "band", "tp", "fp", F.coalesce(F.sum("pos").over(above), zero).alias("pos0"), F.coalesce(F.sum("neg").over(above), zero).alias("neg0"), F.sum("pos").over(all_).alias("p"), F.sum("neg").over(all_).alias("n")).checkpoint()

    def precision(key: tuple, pdf: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        pdf, offsets, out = pdf.sort_values("prob", ascending=False), offsets.sort_values("rep"), []
        for reps, pos, neg in band_draws(pdf, seed, key[0], totals[key[0]]):
            mine = offsets.iloc[reps[0] : reps[-1] + 1]
            tp = mine["pos0"].to_numpy()[:, None] + np.cumsum(pos, axis=1)
            seen = tp + mine["neg0"].to_numpy()[:, None] + np.cumsum(neg, axis=1)
            part = np.where(pos > 0, pos * tp / np.maximum(seen, 1), 0.0).sum(axis=1) / np.maximum(mine["p"].to_numpy(), 1)
            out.append(pd.DataFrame({"rep": reps, "part": part}))
        return pd.concat(out)

    parts = ties.groupBy("__band").cogroup(of.groupBy("band")).applyInPandas(precision, "rep int, part double")
    scores = of.groupBy("rep").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.max("p").alias("p"), F.max("n").alias("n")).filter("p > 0 AND n > 0")
    scores = scores.join(parts.groupBy("rep").agg(F.sum("part").alias("average_precision")), "rep")
    scores = scores.select("average_precision", (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).alias("f1"), (F.col("tp") / F.col("p")).alias("recall"))
    ends = lambda m: F.percentile(m, F.array(F.lit(0.025), F.lit(0.975)))
    out = scores.agg(F.count(F.lit(1)).alias("n_usable"), *[ends(m).alias(m) for m in ("average_precision", "f1", "recall")])
    some = F.col("n_usable") >= 2
    return out.select("n_usable", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(some, F.col(m)[0]).alias("low"), F.when(some, F.col(m)[1]).alias("high")) for m in ("average_precision", "f1", "recall")])))


def interval_widths(clustered: DataFrame, rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Widths of both kinds of intervals and how many times wider the clustered one is; null where the other has no width."""
    width = lambda df, name: df.select(*by, "metric", (F.col("high") - F.col("low")).alias(name))
    both = width(clustered, "clustered_width").join(width(rows, "row_width"), [*by, "metric"])
    return both.withColumn("ratio", F.col("clustered_width") / F.nullif(F.col("row_width"), F.lit(0.0)))


def mean_widths(widths: DataFrame, by: list[str]) -> DataFrame:
    """Means over runs, undefined ratios left out and counted."""
    return widths.groupBy(*by).agg(*[F.round(F.avg(c), 3).alias(c) for c in ("clustered_width", "row_width", "ratio")], F.count_if(F.col("ratio").isNull()).alias("n_undefined"))
